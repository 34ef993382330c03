"""Line de-duplication by passages of lines.

A passage is removable from a number of lines and characters on.  The least removable passages that
begin or end at each line are hashed; those that occur earlier (in document order, then within the
document, without overlap) are removed, after their bytes have been compared with those of the first
occurrence.  Every repeated passage is the union of such least ones, whatever lines surround it.

``Chunking`` is a sparser rule: a rolling hash over the hashes of the last lines chooses chunk
boundaries, and whole chunks are compared, so a passage loses only the chunks that fall inside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.llm._shared import Scratch, free_names, small_batches


@dataclass(frozen=True)
class Chunking:
    """Lines in the rolling hash, one boundary in so many lines, chunk sizes, and what is removable."""

    window: int = 2
    divisor: int = 3
    least: int = 2
    most: int = 16
    removable_lines: int = 2
    removable_chars: int = 40


@dataclass(frozen=True)
class Passages:
    """What is removable, and how many empty lines a least passage may begin or end with."""

    removable_lines: int = 2
    removable_chars: int = 40
    most_blank: int = 64


Rule = Chunking | Passages
#: Rows of a batch at most, and bytes of the passages in it.
ROWS, BODIES = 50_000, 2_000_000


def passages(lines: list[str], how: Passages) -> list[tuple[int, int]]:
    """(first line, end) of the least removable passages that begin or end at each line, in order.

    Those that begin with more than ``most_blank`` empty lines, or end with them, are left out: each
    would repeat the rest of a long blank run.  Their other lines belong to shorter passages.
    """
    n, blank = len(lines), how.most_blank
    total = list(accumulate(map(len, lines), initial=0))
    found = set()
    stop = 0
    for first in range(n):
        stop = max(stop, first + how.removable_lines)
        while stop < n and total[stop] - total[first] < how.removable_chars:
            stop += 1
        if stop > n or total[stop] - total[first] < how.removable_chars:
            break
        if stop - first <= blank or total[first + blank + 1] > total[first]:
            found.add((first, stop))
    first = n
    for stop in range(n, 0, -1):
        first = min(first, stop - how.removable_lines)
        while first > 0 and total[stop] - total[first] < how.removable_chars:
            first -= 1
        if first < 0 or total[stop] - total[first] < how.removable_chars:
            break
        if stop - first <= blank or total[stop] > total[stop - blank - 1]:
            found.add((first, stop))
    return sorted(found)


def chunks(lines: list[str], how: Chunking) -> list[tuple[int, int]]:
    """(first line, end) of each chunk.

    A boundary follows a line if the sum of the hashes of the last ``window`` lines, each turned by
    its distance, is divisible by ``divisor``, and the chunk has ``least`` lines; the largest chunk
    has ``most``.
    """
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        size = i + 1 - start
        if size < how.least:
            continue
        rolling = 0
        for back in range(min(how.window, i + 1)):
            h = hashes[i - back]
            rolling ^= (h << back | h >> (64 - back)) & 0xFFFFFFFFFFFFFFFF if back else h
        if size >= how.most or rolling % how.divisor == 0:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def _removable(lines: list[str], a: int, b: int, how: Rule) -> bool:
    return b - a >= how.removable_lines and sum(map(len, lines[a:b])) >= how.removable_chars


def _candidates(lines: list[str], how: Rule) -> list[tuple[int, int]]:
    if isinstance(how, Passages):
        return passages(lines, how)
    return [(a, b) for a, b in chunks(lines, how) if _removable(lines, a, b, how)]


#: A document is its id and a hash of its text, so rows that repeat an id don't share what they lose.
KEY = ["row", "mark"]
CHUNK = "row long, mark long, first int, stop int, high long, low long"
_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """row, mark and text of documents that have an id and a text."""
    body = F.col("text").cast("string")
    found = docs.select(F.col(key).cast("long").alias("row"), F.xxhash64(body).alias("mark"), body.alias("text"))
    return found.filter("row is not null and length(text) > 0")


def _digest(body: str) -> tuple[int, int]:
    raw = np.frombuffer(xxhash.xxh3_128_digest(body.encode()), ">i8")
    return int(raw[0]), int(raw[1])


def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)


def chunk_table(documents: DataFrame, how: Rule) -> DataFrame:
    """The candidates of each text (row, mark, text): first line, end, and 128-bit hash."""
    names = [*KEY, "first", "stop", "high", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2_000_000):
            rows = []
            for row, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = text.split("\n")
                for a, b in _candidates(lines, how):
                    rows.append((row, mark, a, b, *_digest("\n".join(lines[a:b]))))
                    if len(rows) >= ROWS:
                        yield _batch(rows, _KINDS, names)
                        rows = []
            yield _batch(rows, _KINDS, names)

    return documents.select(*KEY, "text").mapInArrow(run, CHUNK)


def chunk_texts(with_chunks: DataFrame) -> DataFrame:
    """The bytes of the listed candidates (array of first, stop, high, low, own) of each text."""
    kinds, names = (*_KINDS, pa.bool_(), pa.binary()), [*KEY, "first", "stop", "high", "low", "own", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2_000_000):
            rows, size = [], 0
            for row, mark, text, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = text.split("\n")
                for x in some:
                    body = "\n".join(lines[x["first"] : x["stop"]]).encode()
                    rows.append((row, mark, x["first"], x["stop"], x["high"], x["low"], x["own"], body))
                    size += len(body)
                    if size >= BODIES or len(rows) >= ROWS:
                        yield _batch(rows, kinds, names)
                        rows, size = [], 0
            yield _batch(rows, kinds, names)

    return with_chunks.select(*KEY, "text", "some").mapInArrow(run, f"{CHUNK}, own boolean, body binary")


def repeats(scratch: Scratch, documents: DataFrame, how: Rule) -> DataFrame:
    """row, mark, some (array of first, stop, high, low, own): the candidates whose hash occurs again.

    The first occurrence, marked as own, is that with the smallest (row, mark, first line); a
    candidate of the same text that overlaps it is left out.  Rows that repeat a document are one.
    """
    found = scratch.write(chunk_table(documents, how), "chunks")
    first = F.min(F.struct(*KEY, "first")).alias("at")
    owners = found.groupBy("high", "low").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")
    owners = scratch.write(owners.select("high", "low", F.col("at.row").alias("owner"), F.col("at.mark").alias("owner_mark"), F.col("at.first").alias("owner_first")), "owners")
    same = (F.col("row") == F.col("owner")) & (F.col("mark") == F.col("owner_mark"))
    own = same & (F.col("first") == F.col("owner_first"))
    apart = ~same | (F.col("first") - F.col("owner_first") >= F.col("stop") - F.col("first"))
    repeated = found.join(owners, ["high", "low"]).filter(own | apart)
    return repeated.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("first", "stop", "high", "low", own.alias("own")))).alias("some"))


def unlike(scratch: Scratch, listed: DataFrame) -> DataFrame:
    """row, mark, unlike (array of first, stop): listed candidates with other bytes than the first of their hash."""
    bodies = scratch.write(chunk_texts(listed), "bodies")
    originals = bodies.filter("own").select("high", "low", F.col("body").alias("original")).distinct()
    other = bodies.filter("not own").join(originals, ["high", "low"], "left").groupBy(*KEY, "first", "stop").agg(F.max(F.coalesce(F.col("body") == F.col("original"), F.lit(False))).alias("same"))
    other = other.filter("not same").groupBy(*KEY)
    out = scratch.write(other.agg(F.collect_list(F.struct("first", "stop")).alias("unlike")), "unlike")
    scratch.drop("chunks", "owners", "bodies")
    return out


def _merged(some: list[dict] | None, unlike: list[dict] | None) -> list[tuple[int, int]]:
    """The lines of the candidates (sorted) that occur earlier, as spans apart from each other."""
    out: list[tuple[int, int]] = []
    not_these = {(x["first"], x["stop"]) for x in unlike or ()}
    for x in some or ():
        if x["own"] or (x["first"], x["stop"]) in not_these:
            continue
        if out and x["first"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["stop"]))
        else:
            out.append((x["first"], x["stop"]))
    return out


def _without(text: str | None, cut: list[tuple[int, int]]) -> str | None:
    if not cut:
        return text
    lines, out, done = text.split("\n"), [], 0
    for first, stop in cut:
        out += lines[done:first]
        done = stop
    return "\n".join(out + lines[done:])


def deduplicated(spark: SparkSession, docs: DataFrame, *, how: Rule = Passages(), key: str = "doc_id", added: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with the numbers of lines and of removed lines, and the text without repeated passages.

    ``added`` names the two numbers; no column of ``docs`` may be called so.  Documents are ordered by
    the key, a long, and rows that repeat a key by a hash of their text.  Rows with the same key and
    text are one document read twice: both lose what it loses, and neither is an earlier occurrence
    for the other.  Rows with a null key are kept as they are; a null text stays null, an empty one
    is one empty line, and neither has passages.

    Texts move once, to their candidates; the bytes are compared there, and only candidates that turn
    out unlike (equal hashes of different bytes) are joined afterwards.
    """
    if free_names(docs, *added) != list(added):
        raise ValueError(f"the table has a column of {', '.join(added)} already; name others")
    scratch = Scratch(spark, "lines")
    names = docs.columns
    inner = free_names(docs, "row", "mark", "some", "unlike")
    row, mark, some, other = inner
    own_key = F.col(key).cast("long")

    def renamed(found: DataFrame, what: str, into: str) -> DataFrame:
        return found.select(F.col("row").alias(row), F.col("mark").alias(mark), F.col(what).alias(into))

    found = repeats(scratch, keyed(docs, key), how)
    marked = docs.withColumns({row: own_key, mark: F.xxhash64(F.col("text").cast("string"))})
    joined = scratch.write(marked.join(renamed(found, "some", some), [row, mark], "left").select(*names, row, mark, some), "texts")
    listed = joined.filter(F.col(some).isNotNull()).select(F.col(row).alias("row"), F.col(mark).alias("mark"), F.col("text").cast("string").alias("text"), F.col(some).alias("some"))
    wrong = unlike(scratch, listed)
    if wrong.isEmpty():
        joined = joined.withColumn(other, F.lit(None).cast(wrong.schema["unlike"].dataType))
    else:
        joined = joined.join(renamed(wrong, "unlike", other), [row, mark], "left")
    joined = joined.select(*names, some, other)
    at = names.index("text")
    fields = [T.StructField(n, T.LongType()) for n in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2_000_000):
            texts = batch.column(at).to_pylist()
            cuts = [_merged(x, y) for x, y in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)]
            columns = [*batch.columns[: len(names)]]
            columns[at] = pa.array([_without(x, c) for x, c in zip(texts, cuts, strict=True)], columns[at].type)
            n_lines = pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64())
            n_removed = pa.array([sum(b - a for a, b in c) for c in cuts], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, n_lines, n_removed], names=[*names, *added])

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def report(spark: SparkSession, docs: DataFrame, *, how: Rule = Chunking()) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars and kept_sha256 of every row; the query passes ``Passages()``."""
    found = deduplicated(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), how=how)
    kept = F.coalesce("text", F.lit(""))
    return found.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.length(kept).cast("long").alias("kept_chars"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def thinned(spark: SparkSession, docs: DataFrame, *, how: Rule = Passages()) -> DataFrame:
    """``docs`` with the texts shortened, n_chars following; rows whose text is all repeats go."""
    added = free_names(docs, "n_lines", "n_removed")
    found = deduplicated(spark, docs, how=how, added=(added[0], added[1]))
    removed = F.col(added[1])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(removed > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.filter((removed == 0) | (F.length("text") > 0)).select(*docs.columns)
