"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Texts are normalised to words: A-Z in lower case, runs of digits, letters and anything that is not
ASCII.  Training words stream through the automaton, which keeps the longest suffix read so far that
occurs in some item.  A window of eight consecutive words of an item (the whole item, if shorter)
occurs where that suffix is at least as long.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.llm._shared import Scratch, free_names, small_batches

WINDOW = 8
#: Bytes of item texts in one automaton; more items make more automata, applied in turn.  An
#: automaton needs some 100 bytes of memory for a byte of items in the worst case.
BLOCK_BYTES = 2_000_000
#: Share of hit words beyond which a document goes as a whole.
COVERAGE = 0.5

_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text; a null has none."""
    return text.encode().translate(_SPACE).split() if text else []


class SuffixAutomaton:
    """All sequences of words within the items, with the windows that end in each state.

    Words and items are numbers.  States are places in flat arrays: the longest string's length, the
    link, the first of the state's edges, and the nearest state on the way up the links that has
    windows of its own.  An edge is found by one number made of its state and its word.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        self.words = {w: k for k, w in enumerate(sorted({w for _, sequence in items for w in sequence}))}
        self.base = max(1, len(self.words))
        self.step: dict[int, int] = {}
        self.length, self.link, self.first = array("i", [0]), array("i", [-1]), array("i", [-1])
        self._word, self._next = array("i"), array("i")
        ends: list[tuple[int, array, int]] = []
        for name, sequence in items:
            last, states = 0, array("i")
            for word in sequence:
                last = self._extend(last, self.words[word])
                states.append(last)
            if sequence:
                ends.append((number[name], states, len(sequence)))
        own: set[tuple[int, int, int]] = set()
        for name, states, n in ends:
            size = min(window, n)
            for state in states[size - 1 :]:
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                own.add((state, size, name))
        #: Windows by state: (length, item) pairs from one bound of the state to the next.
        self.sizes, self.items, self.bounds = array("i"), array("i"), {}
        for state, size, name in sorted(own):
            if state not in self.bounds:
                self.bounds[state] = (len(self.sizes), len(self.sizes))
            self.sizes.append(size)
            self.items.append(name)
            self.bounds[state] = (self.bounds[state][0], len(self.sizes))
        self.marked = array("i", [-1]) * len(self.length)
        for state in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist()[1:]:
            self.marked[state] = state if state in self.bounds else self.marked[self.link[state]]
        del self.first, self._word, self._next

    def __getstate__(self) -> dict:
        """The edges travel as two arrays and become a table of numbers again where they are used."""
        known = dict(self.__dict__)
        step = known.pop("step")
        known["edges"] = np.fromiter(step.keys(), np.int64, len(step)), np.fromiter(step.values(), np.int32, len(step))
        return known

    def __setstate__(self, known: dict) -> None:
        keys, values = known.pop("edges")
        self.__dict__ = known
        self.step = dict(zip(keys.tolist(), values.tolist(), strict=True))

    def _edge(self, state: int, word: int, target: int) -> None:
        self.step[state * self.base + word] = target
        self._word.append(word)
        self._next.append(self.first[state])
        self.first[state] = len(self._word) - 1

    def _extend(self, last: int, word: int) -> int:
        step, link, length, base = self.step, self.link, self.length, self.base
        target = step.get(last * base + word)
        if target is not None:
            return target if length[target] == length[last] + 1 else self._split(last, word, target)
        state = len(length)
        length.append(length[last] + 1)
        link.append(0)
        self.first.append(-1)
        at = last
        while at != -1 and at * base + word not in step:
            self._edge(at, word, state)
            at = link[at]
        if at != -1:
            target = step[at * base + word]
            link[state] = target if length[target] == length[at] + 1 else self._split(at, word, target)
        return state

    def _split(self, at: int, word: int, target: int) -> int:
        """A state of its own for the strings of ``target`` that end in ``word`` after ``at``'s."""
        step, link, base = self.step, self.link, self.base
        clone = len(self.length)
        self.length.append(self.length[at] + 1)
        link.append(link[target])
        self.first.append(-1)
        edge = self.first[target]
        while edge != -1:
            self._edge(clone, self._word[edge], step[target * base + self._word[edge]])
            edge = self._next[edge]
        link[target] = clone
        while at != -1 and step.get(at * base + word) == target:
            step[at * base + word] = clone
            at = link[at]
        return clone

    def hits(self, sequence: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, end, number of the item) of each occurrence of a window."""
        found = []
        step, link, length, marked, base = self.step, self.link, self.length, self.marked, self.base
        number = self.words.get
        state = matched = 0
        for i, word in enumerate(sequence):
            word = number(word)
            if word is None:
                state = matched = 0
                continue
            target = step.get(state * base + word)
            if target is None:
                while target is None and state:
                    state = link[state]
                    target = step.get(state * base + word)
                matched = length[state]
                if target is None:
                    continue
            state = target
            matched += 1
            mark = marked[state]
            while mark != -1:
                for k in range(*self.bounds[mark]):
                    if self.sizes[k] <= matched:
                        found.append((i + 1 - self.sizes[k], i + 1, self.items[k]))
                mark = marked[link[mark]]
        return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _automata(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[int, Iterator[SuffixAutomaton]]:
    """The number of blocks of items, and an automaton for each in turn.

    Items with a null id or a null text have no windows.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def made() -> Iterator[SuffixAutomaton]:
        for k in range(blocks):
            rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
            yield SuffixAutomaton(sorted((r["item_id"], words(r["text"])) for r in rows), window)

    return blocks, made()


def found_in(texts: DataFrame, automaton: SuffixAutomaton, key: str) -> DataFrame:
    """key, spans and items of the texts (key, text) that hold a window of the items."""
    shared = texts.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4_000_000):
            keys, spans, items = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := shared.value.hits(words(text)):
                    keys.append(name)
                    spans.append(merged([(a, b) for a, b, _ in found]))
                    items.append(sorted({shared.value.names[x] for *_, x in found}))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(spans, _SPANS), pa.array(items, _ITEMS)], names=[key, "spans", "items"])

    return texts.select(key, "text").mapInArrow(run, f"{key} string, spans array<array<bigint>>, items array<string>")


_SPANS, _ITEMS = pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, cut: bool = False, added: tuple[str, str, str] = ("n_words", "spans", "items")) -> DataFrame:
    """``docs`` with the number of words, the merged runs of hit words, and the ids of matched items.

    ``added`` names these three; no column of ``docs`` may be called so.  With ``cut`` the spans are
    taken out of the texts.  One pass over the texts for each block of the benchmark, without a
    shuffle; what all blocks but the last find goes to a table of hit texts, by digest, which the last
    pass joins.  Null and empty texts have no words, repeated rows come as often as they occur, and
    all columns are kept.
    """
    if free_names(docs, *added) != list(added):
        raise ValueError(f"the table has a column of {', '.join(added)} already; name others")
    names, at = docs.columns, docs.columns.index("text")
    kinds = [T.LongType(), T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(added, kinds, strict=True))])
    scratch = Scratch(spark, "decontamination")
    blocks, automata = _automata(benchmark, window, block_bytes)
    early, source = None, docs
    digest, spans_before, items_before = free_names(docs, "digest", "spans_before", "items_before")
    for k, automaton in enumerate(automata):
        if k < blocks - 1:
            texts = docs.select(F.md5(F.col("text").cast("string").cast("binary")).alias("digest"), F.col("text").cast("string").alias("text"))
            part = scratch.write(found_in(texts, automaton, "digest"), f"block{k}")
            early = part if early is None else early.unionByName(part)
    if early is not None:
        whole = early.groupBy("digest").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
        whole = scratch.write(whole, "early").select(F.col("digest").alias(digest), F.col("spans").alias(spans_before), F.col("items").alias(items_before))
        source = docs.withColumn(digest, F.md5(F.col("text").cast("string").cast("binary"))).join(whole, digest, "left").select(*names, spans_before, items_before)
    shared = spark.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4_000_000):
            counts, spans, items = [], [], []
            texts = batch.column(at).to_pylist()
            before = zip(*(batch.column(len(names) + k).to_pylist() for k in range(2)), strict=True) if batch.num_columns > len(names) else [(None, None)] * len(texts)
            for text, (old_spans, old_items) in zip(texts, before, strict=True):
                sequence = words(text)
                found = shared.value.hits(sequence)
                counts.append(len(sequence))
                spans.append(merged([(a, b) for a, b, _ in found] + [(a, b) for a, b in old_spans or ()]))
                items.append(sorted({shared.value.names[x] for *_, x in found}.union(old_items or ())))
            kept = batch.columns[: len(names)]
            if cut and any(spans):
                kept[at] = pa.array([without_spans(x, s) if s else x for x, s in zip(texts, spans, strict=True)], kept[at].type)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, _ITEMS)], names=[*names, *added])

    return source.mapInArrow(run, schema)


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (two items or more) of every row."""
    found = matches(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        _hit("spans").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def _hit(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x[1] - x[0])


def without_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the bytes from the first to the last word of each span of words."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : places[a][0]])
        done = places[b - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def cleaned(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without what occurs in the benchmark.

    Spans of hit words are cut out of the texts; documents of which they are more than ``coverage``
    go.  Other rows and columns are kept as they are; n_chars, where there is one, follows the text.
    """
    n_words, spans, items = free_names(docs, "n_words", "spans", "items")
    found = matches(spark, docs, benchmark, cut=True, added=(n_words, spans, items))
    kept = found.filter(_hit(spans) <= coverage * F.col(n_words))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)
