"""Language and toxicity: held-out accuracy, determinism, odd rows."""

import random

import numpy as np
import pytest

from cadence.llm import language, toxicity
from tests.llm import corpus


def test_language_of_held_out_rows(spark):
    rng = random.Random(8)
    rows = [(k, corpus.prose(rng, "de" if k % 2 else "en", 60), "de" if k % 2 else "en", "s", 0) for k in range(160)]
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "7 !! 9", "de", "s", 0)]
    table = spark.createDataFrame(rows, corpus.SCHEMA)
    got = {r["doc_id"]: r for r in language.identified(spark, table).collect()}
    truth = {r[0]: r[2] for r in rows[:160]}
    held = [k for k in truth if got[k]["held_out"]]
    assert len(held) > 20 and np.mean([got[k]["lang_pred"] == truth[k] for k in held]) > 0.95
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identified(spark, table.limit(0)).collect() == []


def test_windows_come_from_the_whole_text():
    text = bytes(range(256)) * 100
    found = language.windows_of(text, 6)
    assert len(found) == 6 and all(len(w) == language.WINDOW for w in found)
    assert text.rindex(found[-1]) > len(text) / 2 and language.windows_of(b"ab", 6) == [b"ab".ljust(language.WINDOW, b"\0")]
    assert language.windows_of(b"", 6) == []


def test_language_of_repeated_rows_and_columns_of_any_name(spark):
    rng = random.Random(1)
    rows = [(k % 30, corpus.prose(rng, "de" if k % 2 else "en", 300), "de" if k % 2 else "en", k, k) for k in range(60)] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long, lettered long")
    got = language.identified(spark, table)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == 120


def test_language_tables_equal_convolutions():
    rng = np.random.default_rng(0)
    windows = rng.integers(32, 120, (40, language.WINDOW)).astype(np.uint8)
    model = language.fit(windows, rng.integers(0, 2, 40), ["a", "b"], epochs=1)
    want = []
    for k, w in enumerate(language.WIDTHS):
        embedded = model.embedding[windows]
        stack = np.concatenate([embedded[:, j : language.WINDOW - w + 1 + j] for j in range(w)], axis=2)
        want.append((stack @ model.filters[k] + model.biases[k]).max(1))
    assert np.allclose(model.pooled(windows), np.maximum(np.hstack(want), 0), atol=1e-4)


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(400):
        words = corpus.prose(rng, "en", rng.randint(10, 80)).split(" ")
        toxic = k % 4 == 0
        if toxic:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["grobnik", "plemfart", "zudwick"])
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_of_held_out_rows_and_misspellings(spark, toxic_rows):
    rows, labels = toxic_rows
    rows = [*rows, (900, None, None, None, None), (901, "", "en", "s", 0), (902, "the of and grobnikk plemfaart to in that", "en", "s", 0)]
    table = spark.createDataFrame(rows, corpus.SCHEMA)
    marks = spark.createDataFrame([*labels, (5000, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classified(spark, table, marks).collect()}
    assert len(got) == len(rows)
    truth = {k: t for k, _, t in labels}
    held = [k for k in truth if got[k]["held_out"]]
    assert np.mean([got[k]["predicted"] == truth[k] for k in held]) > 0.95
    assert got[902]["score"] > 0.5
    assert got[900]["predicted"] == got[901]["predicted"] == 0
    civil = toxicity.keep_civil(spark, table, marks)
    assert civil.columns == table.columns and {r["doc_id"] for r in civil.collect()} == {k for k in got if not got[k]["predicted"]}


def test_long_texts_score_as_their_parts(toxic_rows):
    rows, labels = toxic_rows
    model = toxicity.fit([r[1] for r in rows], [t for *_, t in labels])
    long = " ".join(r[1] for r in rows[1:4]) * 300 + " grobnik plemfart"
    raw, offsets = toxicity._flat([long, "the of and", "ß" * 3000 + " grobnik", "", "x"])
    whole = model.logits(raw, offsets, 1 << 30)
    for block in (64, 1_000, toxicity.BLOCK):
        assert np.allclose(model.logits(raw, offsets, block), whole, rtol=0, atol=1e-9)
    assert whole[0] > whole[1]
    constant = toxicity.fit(["a", "b"], [0, 0])
    assert constant.scores(*toxicity._flat(["a", ""])).max() < 0.5


def test_scores_equal_a_plain_version(toxic_rows):
    rows, labels = toxic_rows
    model = toxicity.fit([r[1] for r in rows[:80]], [t for *_, t in labels[:80]])

    def plain(text):
        words = toxicity.FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes().split()
        best = min(model.bias, -10.0)
        for at in range(0, max(1, len(words) - 4), 4):
            total = n = 0
            for word in words[at : at + 8]:
                padded = b" " + word + b" "
                for size in toxicity.SIZES:
                    for k in range(len(padded) - size + 1):
                        near = [np.array([padded[k + j] if j < size else 32], np.uint8) for j in range(6)]
                        total += float(model.grams[list(toxicity.grams(near))[toxicity.SIZES.index(size)][0][0]])
                        n += 1
            best = max(best, total / max(1, n) + model.bias) if words else best
        return best

    texts = [rows[k][1] for k in range(12)] + ["", "a", "ab cd", "One, two; three!"]
    assert np.allclose(model.logits(*toxicity._flat(texts)), [plain(x) for x in texts], atol=1e-5)


def test_calibration_puts_the_threshold_between_classes_that_are_apart():
    rng = np.random.default_rng(3)
    for scale in (0.1, 1.0, 30.0):
        logit = scale * np.concatenate([rng.uniform(-12, -3, 300), rng.uniform(3, 12, 40)])
        target = np.repeat([0, 1], [300, 40])
        slope, shift = toxicity.calibration(logit, target)
        p = 1 / (1 + np.exp(-(slope * logit + shift)))
        assert p[target == 1].min() > toxicity.THRESHOLD > p[target == 0].max()
    assert toxicity.calibration(np.zeros(3), np.zeros(3)) == (1.0, 0.0)


def test_long_labelled_texts_take_part_and_the_sample_is_bounded(spark, toxic_rows):
    rows, labels = toxic_rows
    long = [(k, " ".join([x, *[r[1] for r in rows if r[0] % 4][k % 7 * 30 : k % 7 * 30 + 90]])) for k, x, *_ in rows[:80]]
    assert min(len(x) for _, x in long) > 12_000
    table = spark.createDataFrame(long, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole = toxicity.sampled(spark, table, marks, 1500, 2500, 16_000_000).collect()
    assert len(whole) > 40 and {r["toxic"] for r in whole} == {0, 1} and {r["text"] for r in whole} <= {x for _, x in long}
    assert {r["half"] for r in whole} == set(toxicity.HALVES)
    part = toxicity.sampled(spark, table, marks, 1500, 2500, 100_000).collect()
    assert {r["toxic"] for r in part} == {0, 1} and sum(len(r["text"]) for r in part) == 100_000


def test_clashing_and_repeated_rows_are_kept(spark, toxic_rows):
    rows, labels = toxic_rows
    table = spark.createDataFrame([(*r[:2], 1.0, 2.0) for r in [*rows[:60], rows[0]]], "doc_id long, text string, toxic_score double, _toxic_score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    civil = toxicity.keep_civil(spark, table, marks)
    assert civil.columns == table.columns
    assert {(r["toxic_score"], r["_toxic_score"]) for r in civil.collect()} == {(1.0, 2.0)}
    assert toxicity.classified(spark, table.limit(0), marks).collect() == []
