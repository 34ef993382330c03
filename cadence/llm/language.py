"""Language identification by a byte convolutional network, trained and run in numpy.

Bytes are embedded, filtered at several widths, pooled by maximum over a window of fixed length and
fed to a softmax.  A text is all of its windows; their class probabilities are averaged by the bytes
they hold.  At run time each filter is a sum of table look-ups by pairs of bytes, so no product is
computed per byte.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.llm._shared import Scratch, crc32_of_id, small_batches, text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, DIMS = 8, 8
#: Documents per language and windows per document that a fit may see.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 6
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Languages in order, the embedding, per width the filters and biases, and the softmax."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    softmax: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses by the pair of bytes a filter begins with, and by the pair two bytes later."""
        if not hasattr(self, "_tables"):
            near, far = [], []
            byte = np.arange(65536) >> 8, np.arange(65536) & 255
            for width, filters, bias in zip(WIDTHS, self.filters, self.biases, strict=True):
                part = [self.embedding @ filters[k * DIMS : (k + 1) * DIMS] for k in range(width)]
                near.append(part[0][byte[0]] + part[1][byte[1]] + bias)
                if width > 2:
                    far.append(part[2][byte[0]] + (part[3][byte[1]] if width > 3 else 0))
            self._tables = np.hstack(near).astype(np.float32), np.hstack(far).astype(np.float32)
        return self._tables

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """The strongest response of each filter in each window (rows of bytes)."""
        near, far = self.tables()
        x = np.zeros((windows.shape[1] + 1, len(windows)), np.uint16)
        x[:-1] = windows.T
        pair = x[:-1] << 8 | x[1:]
        out = np.take(near, pair[:-1], axis=0)
        out[:-1, :, FILTERS:] += np.take(far, pair[2:], axis=0)
        # Places at the end where a filter of three or four bytes doesn't fit.
        out[-1, :, FILTERS:] = -np.inf
        out[-2, :, 2 * FILTERS :] = -np.inf
        return np.maximum(out.max(axis=0), 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        hidden = self.pooled(windows)
        odds = hidden @ self.softmax[:-1] + self.softmax[-1]
        odds = np.exp(odds - odds.max(1, keepdims=True))
        return odds / odds.sum(1, keepdims=True)

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each whole text and its averaged probability; ties go to the first."""
        sizes = np.diff(offsets)
        per = -(-sizes // WINDOW)
        total = np.zeros((len(sizes), len(self.languages)))
        owner = np.repeat(np.arange(len(sizes)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        begin = offsets[:-1][owner] + nth * WINDOW
        held = np.minimum(WINDOW, offsets[1:][owner] - begin)
        padded = np.append(raw, np.zeros(WINDOW, np.uint8))
        inside = np.arange(WINDOW)
        for at in range(0, len(owner), 64):
            some = slice(at, at + 64)
            windows = padded[begin[some, None] + inside]
            windows[inside >= held[some, None]] = 0
            np.add.at(total, owner[some], self.probabilities(windows) * held[some, None])
        mean = total / np.maximum(1, sizes)[:, None]
        best = mean.argmax(1)
        return [self.languages[k] for k in best], np.clip(mean[np.arange(len(best)), best], 0, 1)


def fit(windows: np.ndarray, target: np.ndarray, languages: list[str], *, epochs: int = 6, seed: int = 11) -> LanguageModel:
    """Train on rows of bytes with the numbers of their languages, by Adam."""
    rng = np.random.default_rng(seed)
    wide = FILTERS * len(WIDTHS)
    theta = [rng.normal(0, 0.5, (256, DIMS)), *(rng.normal(0, 1 / np.sqrt(w * DIMS), (w * DIMS, FILTERS)) for w in WIDTHS), *(np.zeros(FILTERS) for _ in WIDTHS), rng.normal(0, 0.1, (wide + 1, len(languages)))]
    theta = [x.astype(np.float32) for x in theta]
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    step = 0
    n = len(WIDTHS)
    for _ in range(epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            x = windows[pick]
            rows = np.arange(len(pick))
            embedded = theta[0][x]
            grads = [np.zeros_like(p) for p in theta]
            pools, places = [], []
            for k, w in enumerate(WIDTHS):
                stack = np.concatenate([embedded[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
                response = stack @ theta[1 + k] + theta[1 + n + k]
                place = response.argmax(1)
                pools.append(np.take_along_axis(response, place[:, None], 1)[:, 0])
                places.append((place, stack))
            hidden = np.maximum(np.hstack(pools), 0)
            odds = hidden @ theta[-1][:-1] + theta[-1][-1]
            odds = np.exp(odds - odds.max(1, keepdims=True))
            error = odds / odds.sum(1, keepdims=True)
            error[rows, target[pick]] -= 1
            error /= len(pick)
            grads[-1] = np.vstack([hidden.T @ error, error.sum(0)]) + 1e-4 * theta[-1]
            back = (error @ theta[-1][:-1].T) * (hidden > 0)
            for k, w in enumerate(WIDTHS):
                place, stack = places[k]
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads[1 + n + k] = part.sum(0)
                seen = stack[rows[:, None], place]
                grads[1 + k] = np.einsum("bfd,bf->df", seen, part)
                into = np.einsum("bf,df->bfd", part, theta[1 + k])
                for j in range(w):
                    np.add.at(grads[0], x[rows[:, None], place + j], into[:, :, j * DIMS : (j + 1) * DIMS])
            step += 1
            for p, g, m, v in zip(theta, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LanguageModel(languages, theta[0], theta[1 : 1 + n], theta[1 + n : 1 + 2 * n], theta[-1])


def windows_of(raw: bytes, most: int) -> list[bytes]:
    """Up to ``most`` windows spread over a whole text, each filled up with zeros."""
    starts = range(0, len(raw), WINDOW)
    step = max(1, -(-len(starts) // most))
    return [raw[a : a + WINDOW].ljust(WINDOW, b"\0") for a in starts[::step]]


def sampled(docs: DataFrame, sample_docs: int, sample_windows: int) -> DataFrame:
    """doc_id, lang and window of the sample of ``fit_on``."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.filter("doc_id is not null and lang is not null and length(text) > 0").filter(F.pmod(crc32_of_id("doc_id"), F.lit(4)) != 2)
    keyed = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("at"))
    nth = Window.partitionBy("lang").orderBy("at", "doc_id")
    chosen = keyed.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= sample_docs).select("doc_id").collect()
    ids = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in chosen], "doc_id long").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 8_000_000):
            rows = [(doc, lang, w) for doc, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in windows_of(text.encode(), sample_windows)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "lang", "window"])

    return known.join(F.broadcast(ids), "doc_id").select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, window binary")


def fit_on(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> LanguageModel:
    """Fit, in one task, on a bounded sample outside the held-out fold (crc32(doc_id) mod 4 = 2).

    Of each language, the ``sample_docs`` texts with the smallest hashed ids give up to
    ``sample_windows`` windows each, spread over the whole text.  Rows with a null id, text or
    language, and empty texts, take no part; without any row all texts are of unknown language.
    """
    scratch = Scratch(docs.sparkSession, "language")
    sample = scratch.write(sampled(docs, sample_docs, sample_windows), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        languages = sorted({lang for _, lang, _ in rows})
        windows = np.frombuffer(b"".join(w for *_, w in rows), np.uint8).reshape(-1, WINDOW)
        model = fit(windows, np.array([languages.index(lang) for _, lang, _ in rows], np.int64), languages or [UNKNOWN])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    scratch.drop("sample")
    return pickle.loads(found[0]["model"]) if found else fit(np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), [UNKNOWN])


def predicted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text).

    A null text and one without a letter are of unknown language, with score 0.  Other columns are
    ignored, repeated rows come as often as they occur, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("lettered", lettered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 8_000_000):
            names, scores = shared.value.predict(*text_bytes(batch.column(1)))
            lettered = batch.column(2).to_pylist()
            names = [x if ok else UNKNOWN for x, ok in zip(names, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores * np.array(lettered), pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = source.mapInArrow(run, "doc_id long, lang_pred string, score double")
    held = F.coalesce(F.pmod(crc32_of_id("doc_id"), F.lit(4)) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and predict all of them; see ``fit_on`` and ``predicted``."""
    return predicted(docs, fit_on(docs))
