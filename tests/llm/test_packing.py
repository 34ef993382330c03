"""Packing: pieces, places and quality."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache, reduce

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadence.llm import packing
from cadence.llm._shared import Scratch
from cadence.llm.tokens import encoder
from tests.llm import corpus


@lru_cache
def named():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*named().encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_fill_sequences_without_gaps(spark):
    rows = corpus.documents() + [(5, "again", None, None, 0), (5, "again", None, None, 0)]
    got = packing.pack(spark, spark.createDataFrame(rows, corpus.SCHEMA), capacity=256).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for doc, text, *_ in rows:
        if doc == 5:
            continue
        ids = ids_of(text)
        mine = sorted(pieces[doc], key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == list(np.cumsum([0, *(r["length"] for r in mine)])[:-1])
        assert sum(r["length"] for r in mine) == len(ids) and (len(mine) == 1) == (len(ids) <= 256)
        assert all(r["length"] == 256 for r in mine[1:])
        for r in mine:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert len(pieces[5]) == 3
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= sum(r["length"] for r in got) / 256 * 1.1 + 2
    assert packing.pack(spark, spark.createDataFrame([], corpus.SCHEMA)).collect() == []
    special = spark.createDataFrame([(1, "a <|endoftext|> b", 7)], "doc_id long, text string, sequence_id long")
    assert packing.pack(spark, special).first()["length"] == len(ids_of("a <|endoftext|> b")) == 5


def best_fit(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps), sorted(gaps)


def placed(spark, lengths, capacity, ranges=None):
    """Sequences of documents of such lengths, by the rounds of the operator."""
    scratch = Scratch(spark, "test")
    rows = [(n, [(k, 0, 0, n, 0)]) for k, n in enumerate(lengths)]
    units = spark.createDataFrame(rows, f"size long, docs {packing._UNIT}").repartition(3)
    state = packing.Packing(scratch, capacity, min(lengths))
    if ranges:
        state._ranges = lambda n: ranges
    for low, high in zip([capacity // 2 + 1, capacity // 3 + 1, 1], [capacity + 1, capacity // 2 + 1, capacity // 3 + 1], strict=True):
        some = units.filter((F.col("size") >= low) & (F.col("size") < high))
        if n := some.count():
            state.band(some, n, sum(x for x in lengths if x < low))
    out = defaultdict(list)
    seen = []
    for r in reduce(DataFrame.unionByName, state.placed).collect():
        at = r["offset"]
        for d in r["docs"]:
            out[r["sequence_id"]].append((at, d["length"]))
            at += d["length"]
            seen.append(d["doc_id"])
    assert sorted(seen) == list(range(len(lengths)))
    for parts in out.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= capacity
    return len(out)


def test_rounds_need_about_as_many_sequences_as_best_fit_one_by_one(spark):
    rng = random.Random(4)
    lengths = [rng.randint(1, 60) for _ in range(300)]
    best = best_fit(lengths, 60)[0]
    assert placed(spark, lengths, 60) <= best * 1.03 + 2
    assert placed(spark, lengths, 60, ranges=5) <= best * 1.03 + 5


def test_many_short_documents_fill_the_gaps_of_long_ones(spark, monkeypatch):
    monkeypatch.setattr(packing, "SINGLE_ROUNDS", 2)
    lengths = [260] * 10 + [1] * (10 * 252) + [5] * 8
    assert placed(spark, lengths, 512) <= 12
    assert placed(spark, [7] * 200, 512) == 3


def test_crossings_match_what_sweeps_of_ranges_leave():
    rng = random.Random(6)
    for _ in range(200):
        kinds = [rng.randint(0, 1) for _ in range(rng.randint(0, 40))]
        whole, _ = packing.sweep(kinds)
        want = {(i, g) for i, g in enumerate(whole.tolist()) if g >= 0}
        cuts = sorted(rng.sample(range(len(kinds) + 1), min(3, len(kinds))))
        parts = list(zip([0, *cuts], [*cuts, len(kinds)], strict=True))
        got, places, left = set(), {}, {}
        for k, (a, b) in enumerate(parts):
            mate, rank = packing.sweep(kinds[a:b])
            got |= {(a + i, a + g) for i, g in enumerate(mate.tolist()) if g >= 0}
            places |= {(k, kinds[a + i], r): a + i for i, r in enumerate(rank.tolist()) if r >= 0}
            left[k] = tuple(sum(1 for x in places if x[:2] == (k, kind)) for kind in (packing.UNIT, packing.GAP))
        for own, first, n, other, base in packing.crossings(left).tolist():
            got |= {(places[own, packing.UNIT, first + i], places[other, packing.GAP, base - i]) for i in range(n)}
        assert got == want


def test_encoder_agrees_with_its_tokenizer():
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "'s", "a", "é", "漢字", "1", "\t", "　", "\x85", "<|endoftext|>", "word", "😀", "؀"]
    encode = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(0, 10)))
        assert [*encode.ids(text), 0] == ids_of(text), repr(text)
