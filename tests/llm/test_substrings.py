"""Substring de-duplication against a brute-force version."""

import hashlib
import random

import numpy as np

from cadence.llm import substrings


def brute(rows, length):
    owners = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            owners[s] = min(owners.get(s, doc), doc)
    out = {}
    for doc, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if owners[raw[i : i + length]] < doc:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out[doc] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def random_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "é", "ßtz", "and", "aa", "x", "naïve", "\n"]
    passages = ["".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(8)]
    rows = []
    for doc in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a, b = sorted(rng.choices(range(len(p) + 1), k=2))
                parts.append(p[a:b] if rng.random() < 0.5 else p)
            else:
                parts.append("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80))))
        rows.append((doc * 3 - 20, "".join(parts)))
    rows += [(1000, "a" * 300), (1001, "a" * 49), (1002, "ab" * 100), (1003, "a" * 120), (1004, None), (1005, ""), (1006, rows[5][1]), (1007, rows[5][1])]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in range(2):
        rows = random_rows(seed)
        got = {r["doc_id"]: tuple(r)[1:] for r in substrings.report(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
        assert got == brute(rows, 50)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = "0123456789" * 8
    rows = spark.createDataFrame([(None, text), (4, text), (4, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in substrings.report(spark, rows).collect())
    assert got == [(False, 2, 0), (False, 4, 80), (False, 4, 80), (True, 0, 0), (True, 0, 0)]
    assert substrings.report(spark, rows.limit(0)).collect() == []


def test_many_contexts_of_one_gram_are_split_without_loss(monkeypatch):
    rng = np.random.default_rng(5)
    n, length, gram = 400, 20, 8
    reach = length - gram
    text = rng.integers(97, 99, (n, length + reach)).astype(np.uint8)
    text[:, reach : reach + gram] = 100
    text[: n // 2] = text[rng.integers(n // 2, n, n // 2)]
    docs, low, high = rng.permutation(n), rng.integers(0, 4, n).astype(np.uint8), rng.integers(8, reach + 1, n).astype(np.uint8)
    inside = np.arange(-reach, length)
    text[(inside < -high[:, None].astype(int)) | (inside >= (length - low.astype(int))[:, None])] = 0
    names = np.full(n, 7, np.uint64)
    owners = {}
    strings = {(i, b): text[i, reach - b : reach - b + length].tobytes() for i in range(n) for b in range(low[i], high[i] + 1)}
    for (i, _), s in strings.items():
        owners[s] = min(owners.get(s, n), docs[i])
    for most in (10_000, 30, 1):
        monkeypatch.setattr(substrings, "CONTEXTS", most)
        best, which = substrings.first_documents(docs, names, low, high, text, length, gram)
        assert all(best[which[i], b] == owners[s] for (i, b), s in strings.items())
