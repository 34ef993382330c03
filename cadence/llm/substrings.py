"""Exact substring de-duplication over a sparse suffix array, by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
id.  Each such string has an anchor: the q-gram with the least hash in it, the last of equals.  Equal
strings have equal anchors at equal distances, so only suffixes near anchors need be sorted.

1. The initial buckets of anchors are their q-grams.  Buckets that hold one document are settled; the
   others' members are marked.
2. Marked anchors send the bytes around them.  There the suffix at each offset has a bucket, at first
   that of its eight bytes.  A round sorts the suffixes on their bucket and on the identifier of the
   bucket that the suffix so many bytes later is in, which gives finer buckets of twice the bytes; the
   next round follows the pointers to these.  After the last one a string of ``length`` bytes is named
   by two buckets that overlap, and each name has a smallest document.
3. The covered bytes of each document are put together and cut out.

Matches never cross documents, texts are whole, and names are equal only for equal bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm._shared import Scratch, likely, partitions, small_batches, text_bytes
from cadence.llm.minhash import _CODE, _powers, mixed

LENGTH, GRAM = 50, 20
#: Bytes of text and marked anchors for each bucket that a task gathers, and contexts refined at once.
BUCKET_BYTES, BUCKET_MARKS, CONTEXTS = 16_000_000, 50_000, 20_000
#: Bytes of the first buckets of suffixes.
FIRST = 8
_BASE = 0x2545F4914F6CDD1D | 1
_NONE = np.iinfo(np.int64).max


class Anchors:
    """The anchors of a run of texts: text, place in it, hash, and the strings each one names.

    A string named by an anchor begins ``low`` to ``high`` bytes before it.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> None:
        n, span = len(raw), length - gram + 1
        empty = np.zeros(0, np.int64)
        self.text = self.place = self.low = self.high = empty
        self.hash = np.zeros(0, np.uint64)
        if n < length:
            return
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[raw] * _powers(_BASE, n), out=sums[1:])
        grams = mixed((sums[gram:] - sums[:-gram]) * _powers(pow(_BASE, -1, 1 << 64), n - gram + 1))
        # The least hash in each run of ``span`` grams, the last of equals, by doubling.
        key, where, width = grams, np.arange(len(grams), dtype=np.int64), 1
        while width < span:
            step = min(width, span - width)
            left, right = key[:-step], key[step:]
            take = right <= left
            key, where = np.where(take, right, left), np.where(take, where[step:], where[:-step])
            width += step
        starts = np.arange(len(where))
        owner = np.searchsorted(offsets, starts, side="right") - 1
        whole = starts + length <= offsets[owner + 1]
        starts, where, owner = starts[whole], where[whole], owner[whole]
        if not len(starts):
            return
        fresh = np.append(True, (where[1:] != where[:-1]) | (owner[1:] != owner[:-1]))
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(starts)) - 1
        self.text, self.place = owner[first], where[first] - offsets[owner[first]]
        self.high, self.low = where[first] - starts[first], where[last] - starts[last]
        self.hash = grams[where[first]]

    def ordinals(self) -> np.ndarray:
        """The number of each anchor within its text."""
        if not len(self.text):
            return self.text
        first = np.flatnonzero(np.append(True, self.text[1:] != self.text[:-1]))
        return np.arange(len(self.text)) - np.repeat(first, np.diff(np.append(first, len(self.text))))


def _asked(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """bucket, doc, ordinal and hash of anchors, packed by task; each batch knows its own repeats.

    Of an anchor that a batch holds in several documents one row asks (ordinal -1, always marked);
    its members are marked at once, under bucket -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4_000_000):
            ids = batch.column(0).to_numpy()
            found = Anchors(*text_bytes(batch.column(1)), length, gram)
            if not len(found.text):
                continue
            doc, ordinal = ids[found.text], found.ordinals()
            order = np.lexsort((doc, found.hash))
            h, d = found.hash[order], doc[order]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            sizes = np.diff(np.append(start, len(h)))
            several = d[start] != d[start + sizes - 1]
            known = np.zeros(len(h), bool)
            known[order] = np.repeat(several, sizes)
            leader = np.zeros(len(h), bool)
            leader[order[start[several]]] = True
            bucket = (found.hash % np.uint64(buckets)).astype(np.int64)
            name = (found.hash >> np.uint64(32)).astype(np.uint32)
            rows = [(-1, doc[known], ordinal[known], name[:0])]
            asks = np.flatnonzero(~known | leader)
            asks = asks[np.argsort(bucket[asks], kind="stable")]
            cuts = np.flatnonzero(np.append(True, np.diff(bucket[asks]) != 0)) if len(asks) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(asks)) if len(asks) else [], strict=True):
                some = asks[a:b]
                rows.append((int(bucket[some[0]]), doc[some], np.where(known[some], -1, ordinal[some]), name[some]))
            columns = [pa.array([r[0] for r in rows], pa.int32())]
            columns += [pa.array([_pack(r[k].astype(t)) for r in rows], pa.binary()) for k, t in ((1, "<i8"), (2, "<i4"), (3, "<u4"))]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "docs", "ordinals", "names"])

    return docs.mapInArrow(run, "bucket int, docs binary, ordinals binary, names binary")


def _pack(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True), kind)


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([_unpack(x, kind) for x in column.to_pylist()])


def _marked(asked: DataFrame) -> DataFrame:
    """doc_id, ordinal of the anchors whose bucket holds several documents."""

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, ordinals in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_unpack(docs, "<i8")), pa.array(_unpack(ordinals, "<i4"))], names=["doc_id", "ordinal"])

    def run(group: pa.Table) -> pa.Table:
        doc, ordinal, name = (_joined(group[c], t) for c, t in (("docs", "<i8"), ("ordinals", "<i4"), ("names", "<u4")))
        order = np.lexsort((doc, name))
        doc, ordinal, name = doc[order], ordinal[order], name[order]
        start = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        sizes = np.diff(np.append(start, len(name)))
        several = (doc[start] != doc[start + sizes - 1]) | np.logical_or.reduceat(ordinal < 0, start)
        ok = np.repeat(several, sizes) & (ordinal >= 0)
        return pa.table([pa.array(doc[ok]), pa.array(ordinal[ok])], names=["doc_id", "ordinal"])

    schema = "doc_id long, ordinal int"
    at_once = asked.filter("bucket < 0").select("docs", "ordinals").mapInArrow(known, schema)
    return at_once.unionByName(asked.filter("bucket >= 0").groupBy("bucket").applyInArrow(run, schema))


def _contexts(marked_docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """The bytes around marked anchors, packed by bucket: docs, places, low, high, bytes, name."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.arange(-reach, length)
        for batch in small_batches(batches, "text", 2_000_000):
            ids = batch.column(0).to_numpy()
            raw, offsets = text_bytes(batch.column(1))
            found = Anchors(raw, offsets, length, gram)
            if not len(found.text):
                continue
            marks = batch.column(2)
            owner = np.repeat(np.arange(len(ids)), np.diff(marks.offsets.to_numpy()))
            ordinal = marks.flatten().to_numpy()
            first = np.searchsorted(found.text, np.arange(len(ids) + 1))
            ok = ordinal < (first[1:] - first[:-1])[owner]
            pick = np.unique(first[owner[ok]] + ordinal[ok])
            place = found.place[pick] + offsets[found.text[pick]]
            around = place[:, None] + inside
            text = raw[np.clip(around, 0, len(raw) - 1)]
            high, low = found.high[pick], found.low[pick]
            text[(inside < -high[:, None]) | (inside >= (length - low)[:, None])] = 0
            bucket = (found.hash[pick] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.zeros(0, np.int64)
            rows = []
            for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                some = order[a:b]
                anchors = pick[some]
                rows.append([int(bucket[some[0]]), *(_pack(x) for x in (ids[found.text[anchors]].astype("<i8"), found.place[anchors].astype("<i8"), low[some].astype(np.uint8), high[some].astype(np.uint8), text[some], found.hash[anchors]))])
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(x, pa.binary()) for x in columns[1:])], names=["bucket", "docs", "places", "low", "high", "bytes", "names"])

    return marked_docs.select("doc_id", "text", "marks").mapInArrow(run, "bucket int, docs binary, places binary, low binary, high binary, bytes binary, names binary")


def named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Identifiers of pairs of identifiers, as small as there are pairs: the buckets after one sort."""
    key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
    return np.unique(key, return_inverse=True)[1].reshape(key.shape)


def refined(text: np.ndarray, length: int) -> np.ndarray:
    """The bucket of the string of ``length`` bytes at each offset of rows of bytes.

    Equal numbers mean equal strings.  Each round reads the identifiers of the last one at the same
    offset and as many bytes later as these cover.
    """
    size = min(FIRST, length)
    width = text.shape[1] - size + 1
    key = np.zeros((len(text), width), np.uint64)
    for k in range(size):
        key = key << np.uint64(8) | text[:, k : k + width]
    now = np.unique(key, return_inverse=True)[1].reshape(key.shape)
    while size < length:
        step = min(size, length - size)
        now = named(now[:, :-step], now[:, step:])
        size += step
    return now


def smallest(text: np.ndarray, docs: np.ndarray, has: np.ndarray, length: int) -> np.ndarray:
    """For each row and offset (rows by strings), the smallest document with the string there, where ``has``."""
    best = np.full(has.shape, _NONE)
    if not has.any():
        return best
    name = refined(text, length)[:, : has.shape[1]][has]
    least = np.full(int(name.max()) + 1, _NONE)
    np.minimum.at(least, name, np.broadcast_to(docs[:, None], has.shape)[has])
    best[has] = least[name]
    return best


def _parts(key: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in runs of about ``most``; equal keys stay together."""
    order = np.argsort(key, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(key[order])) + 1, len(key))
    out, start = [], 0
    while start < len(key):
        k = np.searchsorted(ends, start + most, side="right") - 1
        stop = ends[k] if k >= 0 and ends[k] > start else ends[np.searchsorted(ends, start, side="right")]
        out.append(order[start:stop])
        start = stop
    return out


def _hashed(text: np.ndarray) -> np.ndarray:
    key = np.zeros(len(text), np.uint64)
    for k in range(text.shape[1]):
        key = mixed(key + text[:, k].astype(np.uint64) + np.uint64(1))
    return key


def first_documents(docs: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray, text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each distance a string begins before its anchor, the smallest document with the string.

    Members with the same bytes are one; the second result says which row of the first is whose.
    Anchors of one gram are refined together.  If they have too many contexts, strings that reach far
    after the anchor are split by the bytes after it, and the others by the bytes before it.
    """
    reach = length - gram
    rows = np.ascontiguousarray(np.hstack([names.view(np.uint8).reshape(len(names), 8), low[:, None], high[:, None], text]))
    _, lead, which = np.unique(rows.view(f"V{rows.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
    which = which.reshape(-1)
    first = np.full(len(lead), _NONE)
    np.minimum.at(first, which, docs)
    names, low, high, text = names[lead], low[lead], high[lead], text[lead]
    # Column k of a row of bytes is where a string begins that has reach - k bytes before its anchor.
    before = reach - np.arange(reach + 1)
    has = (low[:, None] <= before) & (before <= high[:, None])
    best = np.full((len(lead), reach + 1), _NONE)
    near = (reach + 1) // 2
    for part in _parts(names, CONTEXTS):
        if len(part) <= CONTEXTS:
            best[part] = smallest(text[part], first[part], has[part], length)
            continue
        halves = ((before <= near, text[part][:, reach + gram : length + reach - near]), (before > near, text[part][:, reach - near : reach]))
        for some, shared in halves:
            for piece in _parts(_hashed(shared), CONTEXTS):
                rows_of = part[piece]
                best[rows_of] = np.minimum(best[rows_of], smallest(text[rows_of], first[rows_of], has[rows_of] & some, length))
    return best[:, ::-1], which


def _covered(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, start, stop: bytes covered by strings that a smaller document has, by anchor."""

    def run(group: pa.Table) -> pa.Table:
        doc, place = _joined(group["docs"], "<i8"), _joined(group["places"], "<i8")
        low, high = _joined(group["low"], np.uint8), _joined(group["high"], np.uint8)
        text = _joined(group["bytes"], np.uint8).reshape(len(doc), -1)
        best, which = first_documents(doc, _joined(group["names"], np.uint64), low, high, text, length, gram)
        out = []
        for a in range(0, len(doc), 65536):
            rows = slice(a, a + 65536)
            gone = best[which[rows]] < doc[rows, None]
            edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, nearest = np.nonzero(edge == 1)
            _, farthest = np.nonzero(edge == -1)
            row += a
            out.append((doc[row], place[row] - (farthest - 1), place[row] - nearest + length))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table([pa.array(x) for x in columns], names=["doc_id", "start", "stop"])

    return contexts.groupBy("bucket").applyInArrow(run, "doc_id long, start long, stop long")


def spans(spark: SparkSession, scratch: Scratch, docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, cuts (array of start, stop): the covered bytes of documents (doc_id, text) that have any."""
    # Buckets grow in number with the input, so what a task gathers doesn't.
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, partitions(spark), -(-total // BUCKET_BYTES))
    asked = scratch.write(_asked(docs, buckets, length, gram), "asked")
    marks = _marked(asked).groupBy("doc_id").agg(F.collect_list("ordinal").alias("marks"))
    marks = scratch.write(marks, "marks")
    scratch.drop("asked")
    known = marks.agg(F.sum(F.size("marks"))).first()[0] or 0
    buckets = max(32, partitions(spark), -(-known // BUCKET_MARKS))
    contexts = _contexts(likely(docs, marks, ["doc_id"]).join(marks, "doc_id"), buckets, length, gram)
    found = _covered(contexts, length, gram).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    found = scratch.write(found, "found")
    scratch.drop("marks")
    return found


def merged(cuts: list[dict], size: int) -> list[tuple[int, int]]:
    """Overlapping and touching cuts made one, within a text of that size."""
    out: list[list[int]] = []
    for x in cuts:
        a, b = x["start"], min(x["stop"], size)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def report(spark: SparkSession, docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text).

    A null text is an empty one.  Rows with a null doc_id lose nothing and nothing is held against
    them.  Rows that repeat a doc_id are one document: none is smaller than the other, and what is
    covered in one counts for the same bytes of the other.
    """
    scratch = Scratch(spark, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = spans(spark, scratch, docs.filter("doc_id is not null"), length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 8_000_000):
            rows = []
            raw, offsets = text_bytes(batch.column(1))
            for k, (doc, cuts) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                body = raw[offsets[k] : offsets[k + 1]]
                gone = merged(cuts, len(body))
                digest, done = hashlib.sha256(), 0
                for a, b in [*gone, (len(body), len(body))]:
                    digest.update(body[done:a].tobytes())
                    done = b
                rows.append((doc, len(body), sum(b - a for a, b in gone), len(gone), digest.hexdigest()))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    zero = F.lit(0).cast("long")
    cut = likely(docs, found, ["doc_id"]).join(found, "doc_id").mapInArrow(run, _REPORT)
    # Whole texts are summed up where they are read: only documents that lose bytes are shuffled.
    whole = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    untouched = whole.join(found.select("doc_id"), "doc_id", "left_anti")
    return untouched.select(*(c.split()[0] for c in _REPORT.split(", "))).unionByName(cut)
