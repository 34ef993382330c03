"""Exact top-k search by inner product with norm buckets.

Vectors are grouped by length into buckets, longest first.  A query needs a score over its current
k-th best, theta; in a bucket of longest length L that is a cosine of at least theta / (|q| L).  If
that exceeds 1 the bucket is skipped; if it is low, only length prunes (the prefix of the bucket with
norms of at least theta / |q|); if it is high, coordinates prune: a candidate must agree with the
query on its strongest coordinates, since what the others can add is bounded by the lengths that
remain.  What is left is verified by the full integer product.

The longest bucket gives all queries their first thresholds; queries travel in blocks.  Which blocks
meet which buckets is decided on their bounds alone, before any vector moves; then blocks stream past
the bucket, which a task holds one at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.llm._shared import Scratch, partitions

#: Vectors in a bucket and queries in a block, at most.
BUCKET, BLOCK = 4096, 256
#: Cosine from which coordinates prune before the full product, and how many of them.
COORDINATE_COSINE, COORDINATES = 0.6, 16
SCALE = 256.0
#: Two vectors of this length have a product below 2^63.
LONGEST = 2.0**31
#: Query blocks that one copy of a bucket meets, and parts that the bounds of buckets are joined in.
MEETINGS, PARTS = 64, 16
#: Products of coordinates below this bound are exact in double precision.
EXACT = 2.0**53

ROWS = "dims int, id long, norm double, vector binary"


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: float = SCALE) -> DataFrame:
    """dims, id, norm and the components floor(scale * x) as doubles in a binary.

    Vectors that are null, empty or hold a null or a component that is not finite, and null ids,
    are left out; so are vectors so long (over LONGEST after scaling) that a score need not be a long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = x.values if x.is_valid else None
                if i is None or values is None or not len(values) or values.null_count:
                    continue
                v = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all() or np.abs(v).max() > LONGEST / scale:
                    continue
                v = np.floor(scale * v)
                norm = float(np.sqrt(v @ v))
                if norm <= LONGEST:
                    rows.append((len(v), i, norm, v.astype("<f8").tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["dims", "id", "norm", "vector"])

    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).mapInArrow(run, ROWS)


def _packed(rows: DataFrame, most: int, number: str) -> DataFrame:
    """Rows in their order, packed by partition into blocks of one dimension: ids, norms, vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        open_rows: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal nth, open_rows
            dims = open_rows[0][0]
            columns = [
                pa.array([(part << 32) + nth], pa.int64()),
                pa.array([dims], pa.int32()),
                pa.array([max(r[2] for r in open_rows)], pa.float64()),
                pa.array([np.array([r[1] for r in open_rows], "<i8").tobytes()], pa.binary()),
                pa.array([b"".join(r[3] for r in open_rows)], pa.binary()),
            ]
            nth, open_rows = nth + 1, []
            return pa.RecordBatch.from_arrays(columns, names=[number, "dims", "longest", "ids", "matrix"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_rows and (len(open_rows) >= most or open_rows[0][0] != row[0]):
                    yield block()
                open_rows.append(row)
        if open_rows:
            yield block()

    return rows.select("dims", "id", "norm", "vector").mapInArrow(run, f"{number} long, dims int, longest double, ids binary, matrix binary")


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers: by doubles where exact, else by Python's integers."""
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    if reach < EXACT:
        return queries @ candidates.T
    exact = np.array([[int(x) for x in row] for row in queries], object) @ np.array([[int(x) for x in row] for row in candidates], object).T
    return exact


def bucket_top(ids_q: np.ndarray, queries: np.ndarray, theta: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, candidate, score) of the up to k best of a bucket for each query, by score and id.

    Only candidates that reach the query's theta matter; ``candidates`` come longest first.
    """
    norms_q = np.sqrt((queries**2).sum(1))
    norms = np.sqrt((candidates**2).sum(1))
    slack = 1e-9 * (1 + norms_q)
    cosine = np.full(len(queries), -np.inf)
    reach = norms_q * norms.max(initial=0)
    np.divide(theta, reach, out=cosine, where=(reach > 0) & np.isfinite(theta))
    for kind in ("all", "coordinates"):
        picked = np.flatnonzero((cosine <= 1 + 1e-9) & ((cosine >= COORDINATE_COSINE) == (kind == "coordinates")))
        if kind == "all" and len(picked):
            score = products(queries[picked], candidates)
            for row, q in enumerate(picked):
                prefix = len(ids)
                if np.isfinite(theta[q]) and theta[q] > 0 and norms_q[q] > 0:
                    prefix = int(np.searchsorted(-norms, -(theta[q] - slack[q]) / norms_q[q], side="right"))
                yield from _best(ids_q[q], ids[:prefix], score[row, :prefix], theta[q], k)
            continue
        for q in picked:
            strong = np.argsort(-np.abs(queries[q]), kind="stable")[:COORDINATES]
            known = candidates[:, strong] @ queries[q, strong]
            rest_q = math.sqrt(max(0.0, norms_q[q] ** 2 - (queries[q, strong] ** 2).sum()))
            rest = np.sqrt(np.maximum(0.0, norms**2 - (candidates[:, strong] ** 2).sum(1)))
            left = np.flatnonzero(known + rest_q * rest >= theta[q] - slack[q] * (1 + norms))
            if len(left):
                score = products(queries[q : q + 1], candidates[left])[0]
                yield from _best(ids_q[q], ids[left], score, theta[q], k)


def _best(query: int, ids: np.ndarray, score: np.ndarray, theta: float, k: int) -> Iterator[tuple[int, int, int]]:
    ok = np.flatnonzero((ids != query) & (score >= theta))
    if len(ok) > 4 * k:
        limit = np.partition(score[ok], len(ok) - k)[len(ok) - k]
        ok = ok[score[ok] >= limit]
    order = np.lexsort((ids[ok], -score[ok].astype(object) if score.dtype == object else -score[ok]))[:k]
    for j in ok[order]:
        yield int(query), int(ids[j]), int(score[j])


def _searched(pairs: DataFrame, blocks: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """The best of each bucket for the queries of each block that meets it (block, bucket)."""
    heads = buckets.join(pairs.select("bucket", "copy").distinct(), "bucket").select("bucket", "copy", F.lit(0).alias("kind"), "dims", "ids", "matrix", F.lit(None).cast("binary").alias("theta"))
    asks = blocks.join(pairs, "block").select("bucket", "copy", F.lit(1).alias("kind"), "dims", F.col("ids_q").alias("ids"), F.col("queries").alias("matrix"), "theta")
    parts = 4 * partitions(blocks.sparkSession)
    rows = heads.unionByName(asks).repartition(parts, "bucket", "copy").sortWithinPartitions("bucket", "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = matrix = None
        for batch in batches:
            for row in range(batch.num_rows):
                kind, dims, names, raw, theta = (batch.column(c)[row].as_py() for c in range(2, 7))
                if not kind:
                    ids, matrix = np.frombuffer(names, "<i8"), np.frombuffer(raw, "<f8").reshape(-1, dims)
                    continue
                ids_q = np.frombuffer(names, "<i8")
                limits = np.frombuffer(theta, "<f8") if theta else np.full(len(ids_q), -np.inf)
                found = list(bucket_top(ids_q, np.frombuffer(raw, "<f8").reshape(-1, dims), limits, ids, matrix, k))
                columns = list(zip(*found, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def meetings(blocks: DataFrame, buckets: DataFrame) -> DataFrame:
    """block, bucket, copy: the blocks (block, dims, need) with a query that a bucket (bucket, dims, longest) may serve."""
    bounds = buckets.select("bucket", "dims", "longest", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    asking = blocks.select("block", "dims", "need", F.pmod(F.xxhash64("block"), F.lit(PARTS)).cast("int").alias("part"))
    met = asking.join(bounds, ["dims", "part"]).filter(F.col("longest") >= F.col("need"))
    # Blocks are numbered by partition and place; a copy of a bucket meets about MEETINGS of them.
    many = F.greatest(F.lit(1), F.floor(blocks.count() / F.lit(MEETINGS))).cast("int")
    return met.select("block", "bucket", F.pmod(F.xxhash64("block", F.lit(1)), many).cast("int").alias("copy"))


def top(
    spark: SparkSession,
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    bucket: int = BUCKET,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, ties to the smaller id.

    Candidates are all vectors of the query's dimension but those with its own id.  ``is_query`` is
    a condition on the id column.  Rows that repeat an id count as one vector each; see
    ``quantised`` for what takes no part.  Queries without a candidate give no row.
    """
    scratch = Scratch(spark, "search")
    rows = scratch.write(quantised(vectors, id_column, vector_column), "rows")
    parts = partitions(spark)
    ordered = rows.repartitionByRange(parts, F.col("dims"), F.col("norm").desc(), F.col("id")).sortWithinPartitions(F.col("dims"), F.col("norm").desc(), F.col("id"))
    buckets = scratch.write(_packed(ordered, bucket, "bucket"), "buckets")
    asking = rows.withColumnRenamed("id", id_column).filter(is_query).withColumnRenamed(id_column, "id").dropDuplicates(["dims", "id", "vector"])
    asking = asking.repartitionByRange(max(1, parts // 4), "dims", "norm", "id").sortWithinPartitions("dims", "norm", "id")
    blocks = scratch.write(_packed(asking, block, "block").select("block", "dims", F.col("ids").alias("ids_q"), F.col("matrix").alias("queries")), "blocks")
    bounds = buckets.select("bucket", "dims", "longest")
    lead = bounds.groupBy("dims").agg(F.max(F.struct("longest", (-F.col("bucket")).alias("turned"))).alias("lead"))
    lead = scratch.write(lead.select("dims", (-F.col("lead")["turned"]).alias("bucket"), F.col("lead")["longest"].alias("longest")), "lead")
    no_limit = F.lit(None).cast("binary").alias("theta")
    first = meetings(blocks.select("block", "dims", F.lit(-math.inf).alias("need")), lead)
    seeds = scratch.write(_searched(first, blocks.select("*", no_limit), buckets, k), "seeds")
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = seeds.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") == k).select("query_id", F.col("score").cast("double").alias("least"))
    limits = scratch.write(_limits(blocks, kth), "limits")
    pairs = scratch.write(meetings(limits, bounds.join(lead, ["dims", "bucket"], "left_anti")), "pairs")
    found = seeds.unionByName(_searched(pairs, limits, buckets, k))
    ranked = found.withColumn("rank", F.row_number().over(nth)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _limits(blocks: DataFrame, kth: DataFrame) -> DataFrame:
    """Blocks with theta, the k-th best score so far of each query (minus infinity: none), and need.

    A bucket whose longest vector is shorter than ``need`` serves no query of the block.
    """

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = [(n, i, j) for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, j in enumerate(np.frombuffer(raw, "<i8").tolist())]
            columns = list(zip(*number, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["block", "place", "query_id"])

    listed = blocks.select("block", "ids_q").mapInArrow(ids, "block long, place long, query_id long")
    each = listed.join(kth, "query_id", "left").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "least"))).alias("limits"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            thetas, needs = [], []
            for dims, raw, limits in zip(*(batch.column(c).to_pylist() for c in (1, 3, 4)), strict=True):
                theta = np.array([-np.inf if x["least"] is None else x["least"] for x in limits], "<f8")
                norm = np.sqrt((np.frombuffer(raw, "<f8").reshape(-1, dims) ** 2).sum(1))
                need = np.full(len(theta), -np.inf)
                np.divide(theta, norm, out=need, where=(theta > 0) & (norm > 0))
                thetas.append(theta.tobytes())
                needs.append(float(need.min(initial=np.inf)) * (1 - 1e-9))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(thetas, pa.binary()), pa.array(needs, pa.float64())], names=["block", "dims", "ids_q", "queries", "theta", "need"])

    return blocks.join(each, "block").select("block", "dims", "ids_q", "queries", "limits").mapInArrow(bounded, "block long, dims int, ids_q binary, queries binary, theta binary, need double")
