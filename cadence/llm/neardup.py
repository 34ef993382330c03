"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

1. Texts with the same shingle set are one class, which its first document represents.
2. Classes that share the key of a band share a bucket.  Each is compared with the first one of its
   buckets on full sets, and confirmed links form components.
3. In a bucket whose other members are still in different components, members with a similar sketch
   in another component are compared with each other, in blocks, again on full sets.

So only buckets that the first comparison did not settle are compared member by member, and what
leaves a block is a forest of links, never all pairs.  A bucket with many rows is a run over several
range partitions in step 2, and is cut into blocks in step 3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm._shared import Scratch, free_names, likely, partitions, small_batches, text_bytes
from cadence.llm.components import Forest, components
from cadence.llm.minhash import band_keys, shingle_sets, signatures, sketches, word_hashes


@dataclass(frozen=True)
class Similarity:
    """Words in a shingle, the least similarity in hundredths, and bands of rows of the signature.

    With 25 bands of 5 a pair at 0.85 shares no bucket with probability 4e-7; with 32 bands of 4
    one at 0.8 with 5e-8.  ``margin`` is how far a sketch may fall short of the similarity (five
    standard deviations of a signature).
    """

    words: int = 5
    hundredths: int = 80
    bands: int = 32
    rows: int = 4
    margin: float = 0.16
    block: int = 512

    def linked(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.hundredths * (a + b - common)


TRIPLES = Similarity(words=3, hundredths=85, bands=25, rows=5)
_SIGNED = "doc_id long, mark long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"
#: What tells classes apart: the size of a shingle set and its 128-bit digest.
CLASS = ["n_shingles", "d1", "d2"]


def _sets(column: pa.Array, words: int) -> list[np.ndarray]:
    return shingle_sets(*word_hashes(*text_bytes(column)), words)


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    first, second = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    d1 = np.array([((x ^ first) * second).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
    d2 = np.array([((x ^ (x >> np.uint64(29))) * first).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
    return d1, d2


def signed(documents: DataFrame, how: Similarity) -> DataFrame:
    """Set size, digest of the set, band keys and sketch of every text (doc_id, mark, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1_000_000):
            sets = _sets(batch.column(2), how.words)
            rows = signatures(sets, how.bands * how.rows)
            keys = band_keys(rows, how.rows).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * how.bands), pa.array(keys.reshape(-1)))
            columns = [*batch.columns[:2], pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, _digests(sets)), bands, pa.array([x.tobytes() for x in sketches(rows)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n_shingles", "d1", "d2", "bands", "sketch"])

    return documents.select("doc_id", "mark", "text").mapInArrow(run, _SIGNED)


def set_table(wanted: DataFrame, how: Similarity) -> DataFrame:
    """node and its sorted shingle hashes, from texts with the classes they may stand for (text, nodes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1_000_000):
            sets = _sets(batch.column(0), how.words)
            found = []
            for x, d1, d2, nodes in zip(sets, *(d.tolist() for d in _digests(sets)), batch.column(1).to_pylist(), strict=True):
                found += [(n["node"], x.tobytes()) for n in nodes if (n["n_shingles"], n["d1"], n["d2"]) == (len(x), d1, d2)]
            columns = list(zip(*found, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["node", "shingles"])

    return wanted.select("text", "nodes").mapInArrow(run, "node long, shingles binary")


def bucket_runs(rows: DataFrame) -> DataFrame:
    """key, hub, node, edge from (key, node): buckets of two rows or more, by their first id.

    Rows are dealt by ranges of (key, id), so a large bucket is spread over tasks.  Within a task
    the hub is the smallest id; a bucket at the edge of a task may go on in the next one, so its
    rows are marked and come even if they are alone there.
    """
    parts = partitions(rows.sparkSession)
    dealt = rows.select("key", "node").repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "hub", "node", "edge"]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        opening = True

        def runs(key: np.ndarray, doc: np.ndarray, closing: bool) -> pa.RecordBatch:
            nonlocal opening
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            edge = np.zeros(len(starts), bool)
            edge[0] = opening
            edge[-1] |= closing
            opening = False
            row = np.repeat((sizes > 1) | edge, sizes)
            hub = np.repeat(doc[starts], sizes)
            return pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(hub[row]), pa.array(doc[row]), pa.array(np.repeat(edge, sizes)[row])], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if held[0][0][0] == held[-1][0][-1]:
                continue
            key, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            yield runs(key[:cut], doc[:cut], False)
            held = [(key[cut:], doc[cut:])]
        if held:
            yield runs(*(np.concatenate(x) for x in zip(*held, strict=True)), True)

    return dealt.mapInArrow(run, "key long, hub long, node long, edge boolean")


def members(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """key, hub, node of all buckets of two rows or more (key, node)."""
    runs = scratch.write(bucket_runs(rows), "runs")
    whole = runs.filter("not edge").select("key", "hub", "node")
    edges = runs.filter("edge")
    # At most two buckets of each task meet an edge: so few rows whatever the input holds.
    heads = edges.groupBy("key").agg(F.min("hub").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = edges.join(F.broadcast(heads), "key").select("key", F.col("first").alias("hub"), "node")
    out = scratch.write(whole.unionByName(met), "members")
    scratch.drop("runs")
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The number of values that two sorted arrays without repeats share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def confirmed(pairs: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """The edges (src, dst) of the pairs (hub, node) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs, ids, left, right = (batch.column(k).to_pylist() for k in range(4))
            src, dst = [], []
            for hub, i, a, b in zip(hubs, ids, left, right, strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if 100 * min(len(a), len(b)) >= how.hundredths * max(len(a), len(b)) and how.linked(common(a, b), len(a), len(b)):
                    src.append(i)
                    dst.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    own = pairs.join(sets, "node")
    both = own.join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("other")), "hub")
    return both.select("hub", "node", "other", "shingles").mapInArrow(run, "src long, dst long")


def open_blocks(unsettled: DataFrame, how: Similarity) -> DataFrame:
    """key, i, j, node, component: the members of each block that need full sets.

    ``unsettled`` is (key, node, component, sketch, chunks): a bucket is cut into so many chunks,
    and each pair of chunks is a block.
    """
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("other")
    dealt = unsettled.withColumn("own", chunk).select("key", "node", "component", "sketch", "own", other)
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    least = how.hundredths / 100 - how.margin

    def run(group: pa.Table) -> pa.Table:
        component = group["component"].to_numpy()
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(len(component), -1)
        needed = np.zeros(len(component), bool)
        for k in range(0, len(component), 64):
            same = (sketch[k : k + 64, None, :] == sketch[None, :, :]).mean(2) >= least
            same &= component[k : k + 64, None] != component[None, :]
            needed[k : k + 64] = same.any(1)
        return group.select(["key", "i", "j", "node", "component"]).filter(pa.array(needed))

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "key long, i int, j int, node long, component long")


def block_links(blocks: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """A forest of the confirmed links between components within each block, as edges."""

    def run(group: pa.Table) -> pa.Table:
        ids, component = group["node"].to_pylist(), group["component"].to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
        names, column = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        shared = np.bincount(column) > 1
        number = np.cumsum(shared) - 1
        ok = shared[column]
        sizes = np.array([len(x) for x in sets])
        both = np.zeros((len(sets), len(sets)), np.float32)
        width = max(1, int(shared.sum()))
        for a in range(0, width, 4096):
            part = np.zeros((len(sets), min(4096, width - a)), np.float32)
            here = ok & (number[column] >= a) & (number[column] < a + 4096)
            part[owner[here], number[column[here]] - a] = 1
            both += part @ part.T
        links = 100 * both >= how.hundredths * (sizes[:, None] + sizes[None, :] - both)
        forest, out = Forest(), []
        for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(links, 1))), strict=True):
            if forest.join(component[a], component[b]):
                out.append((ids[a], ids[b]))
        columns = list(zip(*out, strict=True)) or [[], []]
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["src", "dst"])

    return blocks.join(sets, "node").groupBy("key", "i", "j").applyInArrow(run, "src long, dst long")


def numbered_classes(scratch: Scratch, usable: DataFrame) -> DataFrame:
    """Classes with their first document (rep, rep_mark) and a number, node, in the order of these."""
    first = F.min(F.struct("doc_id", "mark")).alias("rep")
    classes = usable.groupBy(*CLASS).agg(first).select(*CLASS, F.col("rep.doc_id").alias("rep"), F.col("rep.mark").alias("rep_mark"))
    dealt = classes.repartitionByRange(partitions(scratch.spark), "rep", "rep_mark").sortWithinPartitions("rep", "rep_mark")
    return scratch.write(dealt.withColumn("node", F.monotonically_increasing_id()), "classes")


def grouped(spark: SparkSession, docs: DataFrame, how: Similarity) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, component_mark of every row of ``docs`` (doc_id, text).

    Each row is a document; ``mark`` is a hash of its text.  component_id is the smallest doc_id that
    links reach, and component_mark the mark of the first document with it.  Rows that repeat a
    doc_id with other texts are linked by their own texts only.  Texts without words, null ones
    included, are linked with nothing.  Rows with a null doc_id are their own group, with a null
    component.

    The nodes of all links are classes of equal sets, numbered in the order of their first documents,
    so the smallest number of a component leads to its smallest doc_id.
    """
    scratch = Scratch(spark, "neardup")
    body = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("text"))
    rows = scratch.write(signed(docs, how), "signed")
    usable = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = numbered_classes(scratch, usable)
    ends = classes.withColumnsRenamed({"rep": "doc_id", "rep_mark": "mark"})
    reps = usable.join(ends, ["doc_id", "mark", *CLASS]).select("node", "bands", "sketch").dropDuplicates(["node"])
    reps = scratch.write(reps, "reps")
    found = members(scratch, reps.select(F.explode("bands").alias("key"), "node"))
    needed = ends.join(found.select("node").distinct(), "node", "left_semi")
    needed = scratch.write(needed.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("node", *CLASS)).alias("nodes")), "needed")
    sets = scratch.write(set_table(likely(docs, needed, ["doc_id", "mark"]).join(needed, ["doc_id", "mark"]), how).dropDuplicates(["node"]), "sets")
    pairs = found.filter("node <> hub").select("hub", "node").distinct()
    edges = scratch.write(confirmed(pairs, sets, how), "edges")
    labels = components(scratch, edges, "first")
    known = found.join(labels, "node", "left")
    known = scratch.write(known.select("key", "hub", "node", F.coalesce("component", "node").alias("component")), "known")
    # The hub has been compared with all others, so a bucket is settled if these are one component.
    rest = known.filter("node <> hub").groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("n"))
    rest = rest.filter("a <> b").select("key", F.ceil(F.col("n") / how.block).cast("int").alias("chunks"))
    unsettled = known.filter("node <> hub").join(rest, "key").join(reps.select("node", "sketch"), "node")
    blocks = scratch.write(open_blocks(unsettled.select("key", "node", "component", "sketch", "chunks"), how), "blocks")
    more = scratch.write(block_links(blocks, sets, how), "more")
    final = components(scratch, labels.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(more), "last")
    scratch.drop("needed", "sets", "members", "known", "blocks", "edges", "reps")
    linked = final.filter("node <> component").join(classes.select(F.col("node").alias("component"), F.col("rep").alias("c"), F.col("rep_mark").alias("m")), "component").select("node", "c", "m")
    by_class = classes.join(linked, "node", "left").select(*CLASS, F.coalesce("c", "rep").alias("component_id"), F.coalesce("m", "rep_mark").alias("component_mark"))
    joined = rows.select("doc_id", "mark", *CLASS).join(by_class, CLASS, "left")
    own = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return joined.select("doc_id", "mark", "n_shingles", *(F.when(own, F.col(c)).otherwise(F.col(f"component_{n}")).alias(f"component_{n}") for c, n in (("doc_id", "id"), ("mark", "mark"))))


def report(spark: SparkSession, docs: DataFrame, how: Similarity = TRIPLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (whether the row's id is its component's smallest)."""
    found = grouped(spark, docs, how).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(spark: SparkSession, docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """The rows of ``docs`` that are the first document of their near-duplicate group, all columns kept.

    Of rows that repeat a doc_id within a group the text with the smallest hash stays; rows equal in
    id and text are one document read twice and share its fate.
    """
    doc_id, mark = free_names(docs, "gone_id", "gone_mark")
    found = grouped(spark, docs, how).filter("doc_id <> component_id or mark <> component_mark")
    gone = found.select(F.col("doc_id").alias(doc_id), F.col("mark").alias(mark)).distinct()
    same = (F.col("doc_id").cast("long") == F.col(doc_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(mark))
    return docs.join(gone, same, "left_anti")
