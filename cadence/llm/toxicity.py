"""Toxicity scores by a subword bag: averaged n-gram vectors under a linear softmax.

Each window of a few words is the bag of the character n-grams of its words, boundaries included,
so a misspelling shares most n-grams with the word it comes from.  The vectors of the hashed n-grams
and the softmax are trained jointly in numpy.  Labels hold for documents, so training alternates:
windows of toxic documents start as toxic, then only those that the model itself finds most toxic
stay, beside the most toxic-looking windows of the other documents.  A document scores as its most
toxic window, calibrated on documents that a fit left out.

Fits run in tasks: one on the whole sample, and one for each half of it, whose logits for the other
half calibrate the first.  A fitted model is linear in the average, so each n-gram needs only one
number at scoring time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.llm._shared import Scratch, crc32_of_id, free_names, small_batches, text_bytes

SIZES = (3, 4, 5, 6)
BITS = 18
WINDOW, STRIDE = 8, 4
#: Documents of either class that a fit may see, and the characters of all of them together.
SAMPLE_TOXIC, SAMPLE_OTHER, SAMPLE_CHARS = 1500, 2500, 16_000_000
THRESHOLD = 0.7
#: Places whose n-grams are held at once, and bytes of short texts that are taken together.
BLOCK = 250_000
SPACE = 32


def _fold() -> np.ndarray:
    fold = np.full(256, SPACE, np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            fold[b] = ord(chr(b).lower()) if b < 128 else b
    return fold


FOLD = _fold()


@dataclass
class Windows:
    """Folded texts with a space around each, and the places and texts of their windows, in order."""

    folded: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    owner: np.ndarray


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then the same for the next."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - first, count)


def windows_of(raw: np.ndarray, texts: list[tuple[int, int, int]], stride: int = STRIDE) -> Windows:
    """The windows of whole texts (owner, start, stop) of ``raw``."""
    sizes = np.array([b - a for _, a, b in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    x = np.full(int(starts[-1] + sizes[-1]) + 8, SPACE, np.uint8)
    for (_, a, b), at in zip(texts, starts.tolist(), strict=True):
        x[at : at + b - a] = raw[a:b]
    x = FOLD[x]
    word = x != SPACE
    first = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    part = np.searchsorted(starts, first, side="right") - 1
    words = np.bincount(part, minlength=len(texts))
    low = np.cumsum(words) - words
    per = np.maximum(1, -(-(words - (WINDOW - stride)) // stride)) * (words > 0)
    at = _ranges(np.zeros(len(per), np.int64), per) * stride + np.repeat(low, per)
    stop = np.minimum(at + WINDOW, np.repeat(low + words, per))
    last = np.append(first, 0)
    end = np.where(stop < np.repeat(low + words, per), last[stop] - 1, np.repeat(starts + sizes, per))
    return Windows(x, first[at] - 1, end, np.repeat(np.array([o for o, _, _ in texts], np.int64), per))


def grams(near: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and validity of the n-grams of each size, from the bytes at places and after them.

    Only the first and the last byte may be a space, so an n-gram is part of one word and its ends.
    """
    wide = [b.astype(np.uint32) for b in near]
    key = wide[0] | wide[1] << 8 | wide[2] << 16
    ok = near[1] != SPACE
    for size in SIZES:
        if size > 3:
            key = key * np.uint32(0x85EBCA6B) ^ wide[size - 1] * np.uint32(0xC2B2AE35)
            ok = ok & (near[size - 2] != SPACE)
        h = key * np.uint32(0x9E3779B1)
        yield ((h ^ h >> 15) * np.uint32(0x2C1B3C6D) >> (32 - BITS)).astype(np.int32), ok


@dataclass
class ToxicityModel:
    """One number for each hashed n-gram, the bias, and the calibration of a document's score."""

    grams: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def windows(self, found: Windows, block: int = BLOCK) -> np.ndarray:
        """The logit of each window; sums run over blocks of places, so texts of any length fit."""
        x, n = found.folded, len(found.folded) - 7
        sums = {k: np.zeros((2, len(found.begin))) for k in ("begin", "end")}
        carry = np.zeros(2)
        for a in range(0, n, block):
            b = min(n, a + block)
            each, count = np.zeros(b - a, np.float32), np.zeros(b - a, np.int8)
            for gram, ok in grams([x[a + k : b + k] for k in range(max(SIZES))]):
                each += self.grams[gram] * ok
                count += ok
            run = np.zeros((2, b - a + 1))
            np.cumsum(each, out=run[0, 1:])
            np.cumsum(count, out=run[1, 1:])
            run += carry[:, None]
            for k, places in (("begin", found.begin), ("end", found.end)):
                here = slice(*np.searchsorted(places, (a, b + (b == n))))
                sums[k][:, here] = run[:, places[here] - a]
            carry = run[:, -1].copy()
        total = sums["end"] - sums["begin"]
        return total[0] / np.maximum(1, total[1]) + self.bias

    def logits(self, raw: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """The logit of the most toxic window of each text; of no window, the bias or less."""
        out = np.full(len(offsets) - 1, min(self.bias, -10.0))
        for group in _groups(offsets, block):
            found = windows_of(raw, group)
            np.maximum.at(out, found.owner, self.windows(found, block))
        return out

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(raw, offsets) + self.shift, -50, 50)))


def _groups(offsets: np.ndarray, most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Texts that are not empty as (number, start, stop), in runs of about so many bytes."""
    group, size = [], 0
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if group and size + b - a > most:
            yield group
            group, size = [], 0
        if b > a:
            group.append((k, a, b))
            size += b - a
    if group:
        yield group


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [x.encode() for x in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def _fit_windows(model: tuple[np.ndarray, np.ndarray], rows: list[np.ndarray], target: np.ndarray, epochs: int, rng: np.random.Generator, rate: float = 0.3) -> None:
    """Adagrad on the vectors and the softmax over bags of n-grams, in place."""
    vectors, weights = model
    dims = vectors.shape[1]
    squares = np.full((len(vectors), 1), 1e-6, np.float32)
    squares_w = np.full_like(weights, 1e-6)
    balance = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum())) * len(target)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            sizes = np.array([len(rows[k]) for k in pick])
            flat = np.concatenate([rows[k] for k in pick])
            mean = np.add.reduceat(vectors[flat], np.cumsum(sizes) - sizes) / sizes[:, None]
            hidden = np.hstack([mean, np.ones((len(pick), 1), np.float32)])
            odds = hidden @ weights
            odds = np.exp(odds - odds.max(1, keepdims=True))
            error = odds / odds.sum(1, keepdims=True)
            error[np.arange(len(pick)), target[pick]] -= 1
            error *= balance[pick, None]
            back = (error @ weights[:dims].T).astype(np.float32)
            grad_w = hidden.T @ error / len(pick)
            squares_w += grad_w**2
            weights -= rate * grad_w / np.sqrt(squares_w)
            sort = np.argsort(flat, kind="stable")
            ordered = flat[sort]
            starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            ids = ordered[starts]
            grad = np.add.reduceat((back / sizes[:, None].astype(np.float32))[np.repeat(np.arange(len(pick)), sizes)[sort]], starts)
            squares[ids] += (grad**2).mean(1, keepdims=True)
            now = vectors[ids]
            vectors[ids] = now - rate * grad / np.sqrt(squares[ids]) - 1e-4 * now


def fit(texts: list[str], labels: list[int], *, dims: int = 8, rounds: int = 3, seed: int = 7) -> ToxicityModel:
    """Fit a model, not calibrated yet, on whole texts with labels 0 or 1; one class gives constant scores."""
    rng = np.random.default_rng(seed)
    target = np.array(labels, np.int64)
    raw, offsets = _flat(texts)
    if not len(target) or target.min() == target.max() or not len(raw):
        level = 4.0 if len(target) and target.min() == 1 else -4.0
        return ToxicityModel(np.zeros(1 << BITS, np.float32), level, 0.0, level)
    found = windows_of(raw, [x for group in _groups(offsets, len(raw)) for x in group])
    toxic = target[found.owner] == 1
    model = (rng.normal(0, 0.1, (1 << BITS, dims)).astype(np.float32), rng.normal(0, 0.1, (dims + 1, 2)))

    def linear() -> ToxicityModel:
        vectors, weights = model
        difference = weights[:, 1] - weights[:, 0]
        return ToxicityModel((vectors @ difference[:dims]).astype(np.float32), float(difference[dims]))

    def rows(picked: np.ndarray) -> list[np.ndarray]:
        width = found.end[picked] - found.begin[picked]
        places = _ranges(found.begin[picked], width)
        both = list(grams([found.folded[places + k] for k in range(max(SIZES))]))
        cuts = np.cumsum(width)
        out = []
        for a, b in zip(cuts - width, cuts, strict=True):
            some = np.concatenate([gram[a:b][ok[a:b]] for gram, ok in both])
            out.append(some if len(some) else np.zeros(1, np.int32))
        return out

    at_toxic, at_other = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    for k in range(rounds + 1):
        if k:
            logit = linear().windows(found)
            best = np.full(len(target), -np.inf)
            np.maximum.at(best, found.owner, logit)
            keep = at_toxic[logit[at_toxic] >= np.maximum(best[found.owner[at_toxic]] - 1e-9, 2.0 if k > 1 else np.inf)]
            keep = np.union1d(keep, at_toxic[logit[at_toxic] >= best[found.owner[at_toxic]] - 1e-9])
            hard = at_other[np.argsort(-logit[at_other], kind="stable")[: 2 * len(keep) + 500]]
            plain = rng.choice(at_other, min(len(at_other), 2 * len(keep) + 2000), replace=False)
            others = np.union1d(hard, plain)
        else:
            keep = rng.choice(at_toxic, min(len(at_toxic), 12_000), replace=False)
            others = rng.choice(at_other, min(len(at_other), 12_000), replace=False)
        picked = np.concatenate([keep, others])
        _fit_windows(model, rows(picked), np.repeat([1, 0], [len(keep), len(others)]), 3, rng)
    return linear()


def calibration(logit: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve for logits of texts that the fit did not see.

    Logits are brought to one scale first, so the penalty, which keeps the slope finite where the
    classes are apart, means the same for every model; the curve then turns between the classes.
    """
    if not len(target) or target.min() == target.max():
        return 1.0, 0.0
    middle, scale = np.median(logit), max(1e-9, float(np.std(logit)))
    x = np.column_stack([(logit - middle) / scale, np.ones_like(logit)])
    theta, weak = np.array([1.0, 0.0]), np.array([1e-2, 1e-4])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((np.logaddexp(0, z) - target * z).sum() + 0.5 * (weak * at**2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(x.T @ (x * w[:, None]) + np.diag(weak), x.T @ (p - target) + weak * theta)
        while loss(theta - step) > loss(theta) and np.abs(step).max() > 1e-9:
            step = step / 2
        theta = theta - step
        if np.abs(step).max() < 1e-9:
            break
    slope = max(theta[0], 1e-3)
    return float(slope / scale), float(theta[1] - slope * middle / scale)


#: Fits by number: on everything, on the first half, on the second half.
WHOLE, HALVES = 0, (1, 2)


def _fitted(sample: DataFrame) -> DataFrame:
    """which, model, logits and targets of the texts left out, from (which, inside, id, text, toxic).

    A task fits each of the numbers it holds; the sample is bounded, and so is the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[tuple]] = {}
        for batch in batches:
            for which, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known.setdefault(which, []).append(tuple(row))
        for which, rows in sorted(known.items()):
            rows.sort(key=lambda r: (r[1], r[2]))
            inside = [r for r in rows if r[0]]
            model = fit([r[2] for r in inside], [r[3] for r in inside])
            out = [r for r in rows if not r[0]]
            logits = model.logits(*_flat([r[2] for r in out]))
            columns = [pa.array([which], pa.int32())] + [pa.array([x], pa.binary()) for x in (pickle.dumps(model), logits.astype("<f8").tobytes(), np.array([r[3] for r in out], "<i8").tobytes())]
            yield pa.RecordBatch.from_arrays(columns, names=["which", "model", "logits", "targets"])

    return sample.select("which", "inside", "id", "text", "toxic").mapInArrow(run, "which int, model binary, logits binary, targets binary")


def fit_on(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample_toxic: int = SAMPLE_TOXIC,
    sample_other: int = SAMPLE_OTHER,
    sample_chars: int = SAMPLE_CHARS,
) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows outside the held-out fold (crc32(doc_id) mod 3 = 1).

    The rows of either class with the smallest hashed ids are taken, whatever their length, until the
    class has its share of ``sample_chars``; a piece from a hashed place in the text that passes the
    share fills it up.  Labels other than 0 and 1, null ids and null texts take no part.
    """
    chosen = sampled(spark, docs, labels, sample_toxic, sample_other, sample_chars)
    if chosen is None:
        return fit([], [])
    every = F.explode(F.array(*(F.struct(F.lit(k).alias("which"), ((F.lit(k) == WHOLE) | (F.col("half") == k)).alias("inside")) for k in (WHOLE, *HALVES)))).alias("f")
    rows = chosen.select("id", "text", "toxic", every).select("f.*", "id", "text", "toxic")
    found = {r["which"]: r for r in _fitted(rows.repartitionByRange(1 + len(HALVES), "which")).collect()}
    if WHOLE not in found:
        return fit([], [])
    model = pickle.loads(found[WHOLE]["model"])
    logits, targets = (np.concatenate([np.frombuffer(found[k][c], t) for k in HALVES if k in found]) for c, t in (("logits", "<f8"), ("targets", "<i8")))
    if model.grams.any():
        model.slope, model.shift = calibration(logits, targets)
    return model


def sampled(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_toxic: int, sample_other: int, sample_chars: int) -> DataFrame | None:
    """id, text, toxic and half of the sample of ``fit_on``; none if there is no labelled text."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.filter("doc_id is not null and toxic in (0, 1)").filter(F.pmod(crc32_of_id("doc_id"), F.lit(3)) != 1)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("n")).filter("n > 0")
    known = usable.join(known.groupBy("doc_id").agg(F.sum("n").alias("n")), "doc_id").withColumn("at", F.xxhash64("doc_id"))
    scratch = Scratch(spark, "toxicity")
    known = scratch.write(known, "known")
    picked: list[tuple[int, int, int, int, int]] = []
    for label, bound in ((1, sample_toxic), (0, sample_other)):
        left = sample_chars * bound // (sample_toxic + sample_other)
        for k, r in enumerate(known.filter(F.col("toxic") == label).orderBy("at", "doc_id").limit(bound).collect()):
            if left <= 0:
                break
            size = min(r["n"], left)
            picked.append((r["doc_id"], label, r["at"] % (r["n"] - size + 1), size, HALVES[k % 2]))
            left -= size
    scratch.drop("known")
    if not picked:
        return None
    chosen = spark.createDataFrame(sorted(picked), "id long, toxic int, skipped long, size long, half int")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    part = F.substring("text", (F.col("skipped") + 1).cast("int"), F.col("size").cast("int"))
    return texts.join(F.broadcast(chosen), "id").select("id", part.alias("text"), "toxic", "half").filter(F.length("text") > 0)


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", into: str = "toxic_score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each whole text; null and empty texts get the lowest.

    A column that is called ``into`` already raises, since it would be lost.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text)
    if into.lower() in {n.lower() for n in names}:
        raise ValueError(f"the table has a column {into} already; name another one")
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, 4_000_000):
            values = shared.value.scores(*text_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*names, into])

    return docs.mapInArrow(run, schema)


def classified(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; see ``fit_on`` and ``score``."""
    model = fit_on(spark, docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    held = F.coalesce(F.pmod(crc32_of_id("doc_id"), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their own columns."""
    (into,) = free_names(docs, "toxic_score")
    return score(docs, fit_on(spark, docs, labels), into=into).filter(F.col(into) < threshold).drop(into)
