"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best fit, longest documents first.  One round:

1. Gaps (the free ends of open sequences) and documents are dealt by ranges of their size, from the
   largest down, so a task holds neighbours.
2. Each task sweeps its range: a document takes the gap before it that is nearest, its successor in
   size among those that are left; documents that compete for one are served by rank.
3. What is left of a range is first documents without a gap, then gaps without a document.  The
   numbers of both, a pair for each task, tell which rank of an earlier task's gaps serves which rank
   of a later task's documents, and a join on these ranks brings them together.
4. Gaps shrink by what they took, and the next round reads the new table.

Rounds go on until no document of the length band fits; the rest of it opens new sequences, and the
next band follows.  Where gaps take many short documents each, these are put together into units of
half the size in each further round, so the number of rounds stays bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm._shared import Scratch, partitions, small_batches
from cadence.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CAPACITY = 2048
END_ID = 0
#: Rows of a range, and rounds with single documents in a band before units are made.
RANGE_ROWS, SINGLE_ROUNDS = 200_000, 16
#: A round is followed by another if it serves one in so many of what it could.
ENOUGH = 64
#: Shares of the capacity at which a band of lengths begins.
BANDS = (1 / 2, 1 / 3, 1 / 6, 0.0)

_UNIT = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
#: kind: a gap or a unit that is left (with its rank in its range), a placed unit, a gap that shrank.
GAP, UNIT, PLACED, SHRUNK = range(4)
_ROWS = f"kind int, range int, rank long, size long, sequence_id long, offset long, docs {_UNIT}"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    starts = [0, *range(min(first, n), n, capacity)]
    return [(a, (first if a == 0 else capacity)) for a in starts] if n > capacity else [(0, n)]


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of each document; a null text is an empty one (a single end id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).raw
        end = np.array([end_id], "<u4").tobytes()
        for batch in small_batches(batches, "text", 8_000_000):
            ids, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = encode(text or "") + end
                for k, (a, n) in enumerate(cut(len(raw) // 4, capacity)):
                    ids.append(doc_id)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(memoryview(raw)[4 * a : 4 * (a + n)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def sweep(kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For gaps (0) and units (1) from the largest down: the gap of each unit, and its rank if it is left.

    -1 means no gap, or no rank.  Units are ranked in order, gaps by how many larger ones are left.
    """
    mate, rank = np.full(len(kinds), -1), np.full(len(kinds), -1)
    stack: list[int] = []
    waiting = 0
    for i, kind in enumerate(kinds):
        if kind == GAP:
            stack.append(i)
        elif stack:
            mate[i] = stack.pop()
        else:
            rank[i] = waiting
            waiting += 1
    rank[stack] = np.arange(len(stack))
    return mate, rank


def crossings(left: dict[int, tuple[int, int]]) -> np.ndarray:
    """Rows (unit's range, first rank, number, gap's range, gap's rank) that match what ranges have left.

    ``left`` tells the numbers of (units, gaps) of each range, in order of size.  The unit of rank
    first + i takes the gap of rank - i.
    """
    stack: list[list[int]] = []
    out = []
    for k in sorted(left):
        units, gaps = left[k]
        done = 0
        while done < units and stack:
            where, n = stack[-1]
            some = min(units - done, n)
            out.append((k, done, some, where, n - 1))
            done += some
            stack[-1][1] -= some
            if not stack[-1][1]:
                stack.pop()
        if gaps:
            stack.append([k, gaps])
    return np.array(out, np.int64).reshape(-1, 5)


def _rows(table: pa.Table, pick: np.ndarray, kind: int, rank: np.ndarray, size: np.ndarray, sequence: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(pick)
    docs = table.column("docs").take(pa.array(pick))
    columns = [np.full(n, kind, np.int32), np.full(n, TaskContext.get().partitionId(), np.int32), *(np.broadcast_to(x, n).astype(np.int64) for x in (rank, size, sequence, offset))]
    names = ["kind", "range", "rank", "size", "sequence_id", "offset", "docs"]
    yield from pa.table([*map(pa.array, columns), docs], names=names).to_batches(max_chunksize=10_000)


def swept(gaps: DataFrame, units: DataFrame, capacity: int, ranges: int) -> DataFrame:
    """Gaps (size, sequence_id) and units (size, docs) after a sweep of each range; see ``_ROWS``."""
    none = F.lit(None)
    both = gaps.select("size", F.lit(GAP).alias("kind"), "sequence_id", none.cast(_UNIT).alias("docs"), F.col("sequence_id").alias("tie"))
    both = both.unionByName(units.select("size", F.lit(UNIT).alias("kind"), none.cast("long").alias("sequence_id"), "docs", F.xxhash64("docs").alias("tie")))
    order = [F.desc("size"), F.col("kind"), F.col("tie")]
    dealt = both.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        size, kind = (table.column(c).to_numpy() for c in ("size", "kind"))
        sequence = table.column("sequence_id").fill_null(-1).to_numpy()
        mate, rank = sweep(kind.tolist())
        for what in (GAP, UNIT):
            left = np.flatnonzero((kind == what) & (rank >= 0))
            yield from _rows(table, left, what, rank[left], size[left], sequence[left], capacity - size[left])
        placed = np.flatnonzero(mate >= 0)
        gap = mate[placed]
        yield from _rows(table, placed, PLACED, np.int64(0), size[placed], sequence[gap], capacity - size[gap])
        yield from _rows(table, gap, SHRUNK, np.int64(0), size[gap] - size[placed], sequence[gap], capacity - size[gap] + size[placed])

    return dealt.mapInArrow(run, _ROWS)


def _looked_up(rows: DataFrame, runs: np.ndarray, unit: bool) -> DataFrame:
    """``rows`` with the other side's range and rank by ``crossings``, -1 where there is none."""
    own, first, n, other, base = runs.T if unit else (runs[:, 3], runs[:, 4] - runs[:, 2] + 1, runs[:, 2], runs[:, 0], runs[:, 1] + runs[:, 2] - 1)
    key = own << 40 | first
    order = np.argsort(key)
    key, n, other, base, first = (x[order] for x in (key, n, other, base, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, rank = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy()
            at = np.searchsorted(key, where << 40 | rank, side="right") - 1
            within = rank - first[at]
            ok = (at >= 0) & (key[at] >> 40 == where) & (within < n[at])
            columns = [pa.array(np.where(ok, other[at], -1)), pa.array(np.where(ok, base[at] - within, -1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "other_range", "other_rank"])

    return rows.mapInArrow(run, f"{_ROWS}, other_range long, other_rank long")


def opened(units: DataFrame, capacity: int, ranges: int, number: int, most: int) -> DataFrame:
    """Units in new sequences, in order of size: as many to each as fit, and ``most`` at most."""
    dealt = units.repartitionByRange(ranges, F.desc("size"), F.xxhash64("docs")).sortWithinPartitions(F.desc("size"), F.xxhash64("docs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (number << 48) + (TaskContext.get().partitionId() << 32)
        nth, at, held = -1, capacity, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = table.column("size").to_pylist()
            sequence, offset, closed = [], [], []
            for size in sizes:
                if at + size > capacity or held >= most:
                    if nth >= 0:
                        closed.append((first + nth, at))
                    nth, at, held = nth + 1, 0, 0
                sequence.append(first + nth)
                offset.append(at)
                at, held = at + size, held + 1
            yield from _rows(table, np.arange(len(sizes)), PLACED, np.int64(0), np.array(sizes, np.int64), np.array(sequence, np.int64), np.array(offset, np.int64))
            ends = np.array(closed, np.int64).reshape(-1, 2)
            yield from _rows(pa.table({"docs": pa.nulls(1, table.schema.field("docs").type)}), np.zeros(len(ends), np.int64), SHRUNK, np.int64(0), capacity - ends[:, 1], ends[:, 0], ends[:, 1])
            kept = table.schema.field("docs").type
        if nth >= 0:
            yield from _rows(pa.table({"docs": pa.nulls(1, kept)}), np.zeros(1, np.int64), SHRUNK, np.int64(0), np.array([capacity - at]), np.array([first + nth]), np.array([at]))

    return dealt.select("size", "docs").mapInArrow(run, _ROWS)


def united(units: DataFrame, most: int) -> DataFrame:
    """Units of at most ``most`` tokens made of the ones that a task reads in turn; larger ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = 0, []
        for batch in batches:
            sizes, out = [], []
            for size, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if total + size > most and docs:
                    sizes.append(total)
                    out.append(docs)
                    total, docs = 0, []
                total, docs = total + size, docs + some
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(out, batch.schema.field(1).type)], names=["size", "docs"])
            kept = batch.schema.field(1).type
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([docs], kept)], names=["size", "docs"])

    return units.filter(F.col("size") <= most).select("size", "docs").mapInArrow(run, f"size long, docs {_UNIT}")


@dataclass
class Packing:
    """The state between rounds: gaps (size, sequence_id), and the tables of what has been placed."""

    scratch: Scratch
    capacity: int
    least: int
    gaps: DataFrame | None = None
    placed: list[DataFrame] = None
    rounds: int = 0

    def _ranges(self, rows: int) -> int:
        return max(1, min(4 * partitions(self.scratch.spark), -(-rows // RANGE_ROWS)))

    def _keep(self, rows: DataFrame) -> None:
        self.placed = [*(self.placed or []), rows.filter(F.col("kind") == PLACED).select("sequence_id", "offset", "docs")]

    def _open_gaps(self, *tables: DataFrame) -> None:
        for rows in tables:
            part = rows.filter(F.col("size") >= self.least).select("size", "sequence_id")
            self.gaps = part if self.gaps is None else self.gaps.unionByName(part)

    def match(self, units: DataFrame, n: int) -> tuple[DataFrame, int, bool]:
        """One round: the units that found no gap, how many found one, and whether it is worth another.

        It is not once a small share of the gaps, or of the units, whichever are fewer, was served.
        """
        if self.gaps is None:
            return units, 0, False
        self.rounds += 1
        rows = self.scratch.write(swept(self.gaps, units, self.capacity, self._ranges(2 * n)), f"round{self.rounds}")
        counts = {(r["range"], r["kind"]): r["n"] for r in rows.filter(F.col("kind") != SHRUNK).groupBy("range", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        found = sum(n for (_, kind), n in counts.items() if kind == PLACED)
        runs = crossings({k: (counts.get((k, UNIT), 0), counts.get((k, GAP), 0)) for k, _ in counts})
        idle = sum(n for (_, kind), n in counts.items() if kind == GAP)
        self._keep(rows)
        self.gaps = None
        gaps, left = rows.filter(F.col("kind") == GAP), rows.filter(F.col("kind") == UNIT)
        if len(runs):
            asked, used = _looked_up(left, runs, True), _looked_up(gaps, runs, False)
            # Of equal keys there are one unit and one gap, so the join is as large as what it places.
            served = used.filter("other_range >= 0").select("range", "rank", F.col("size").alias("free"), F.col("sequence_id").alias("sequence"))
            met = asked.filter("other_range >= 0").drop("range", "rank").join(served, (F.col("other_range") == F.col("range")) & (F.col("other_rank") == F.col("rank")))
            crossed = self.scratch.write(met.select("size", "free", "sequence", "docs"), f"crossed{self.rounds}")
            self.placed.append(crossed.select(F.col("sequence").alias("sequence_id"), (F.lit(self.capacity) - F.col("free")).alias("offset"), "docs"))
            self._open_gaps(crossed.select((F.col("free") - F.col("size")).alias("size"), F.col("sequence").alias("sequence_id")))
            found += int(runs[:, 2].sum())
            gaps, left = used.filter("other_range < 0"), asked.filter("other_range < 0")
        self._open_gaps(rows.filter(F.col("kind") == SHRUNK), gaps)
        return left.select("size", "docs"), found, found * ENOUGH >= min(n, idle + found)

    def open(self, units: DataFrame, n: int, shorter: int) -> None:
        """New sequences for units that fit in no gap.

        ``shorter`` are the tokens of the bands to come.  As long as these can fill them, gaps are left
        that take several documents, since large gaps are filled better than small ones.
        """
        self.rounds += 1
        sizes = units.agg(F.sum("size").alias("all"), F.max("size").alias("longest")).first()
        free = 0 if self.gaps is None else self.gaps.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        sequences = max(1, (sizes["all"] + shorter - free) // self.capacity)
        most = max(self.capacity // sizes["longest"], -(-n // sequences))
        rows = self.scratch.write(opened(units, self.capacity, self._ranges(n), self.rounds, most), f"round{self.rounds}")
        self._keep(rows)
        self._open_gaps(rows.filter(F.col("kind") == SHRUNK))

    def band(self, units: DataFrame, n: int, shorter: int) -> None:
        """All documents of a band: matched round by round, then opened."""
        for _ in range(SINGLE_ROUNDS):
            units, found, more = self.match(units, n)
            n -= found
            if not more or not n:
                break
        else:
            most = self.capacity // 2
            while n and most >= self.least:
                # A unit in no gap is taken apart again; documents over the bound stay as they are.
                left, _, _ = self.match(united(units, most), n)
                over = units.filter(F.col("size") > most)
                single = left.select(F.explode("docs").alias("d")).select(F.col("d.length").alias("size"), F.array("d").alias("docs"))
                units = self.scratch.write(over.unionByName(single), f"units{self.rounds}")
                n, most = units.count(), most // 2
        if n:
            self.open(units, n, shorter)


def pack(
    spark: SparkSession,
    docs: DataFrame,
    *,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Pack ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents over the capacity are cut into pieces, no others.  Null and empty texts are one end
    id.  A null doc_id is carried as null; repeated rows are packed as often as they occur; other
    columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(tokenised_pieces(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), capacity, end_id), "pieces")
    lows = [int(share * capacity) + 1 for share in BANDS]
    band = sum((F.col("length") < low).cast("int") for low in lows)
    counts = pieces.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("least"), F.sum("length").alias("tokens"))
    known = {r["band"]: r for r in counts.collect()}
    if not known:
        return spark.createDataFrame([], f"{PIECES}, sequence_id long, offset long")
    state = Packing(scratch, capacity, min(r["least"] for r in known.values()))
    names = [x.split()[0] for x in PIECES.split(", ")]
    for k in sorted(known):
        units = pieces.filter(band == k).select(F.col("length").alias("size"), F.array(F.struct(*names)).alias("docs"))
        state.band(units, known[k]["n"], sum(r["tokens"] for r in known.values() if r["band"] > k))
    placed = state.placed[0]
    for more in state.placed[1:]:
        placed = placed.unionByName(more)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            flat = batch.column(2).flatten()
            columns = [flat.field(n) for n in names]
            length = columns[3].to_numpy()
            before = np.cumsum(length) - length
            starts = np.cumsum(sizes) - sizes
            shift = np.repeat(batch.column(1).to_numpy() - (before[starts] if len(starts) else 0), sizes)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(before + shift)], names=[*names, "sequence_id", "offset"])

    return placed.mapInArrow(listed, f"{PIECES}, sequence_id long, offset long")
