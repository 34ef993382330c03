"""Near-duplicate groups against brute force."""

import random
import re

import numpy as np
import pytest

from cadence.llm import minhash, neardup
from tests.llm import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, how):
    sets = {r[0]: shingles(r[1], how.words) for r in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= how.hundredths * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k), root(k) == k) for k in ids}


def chained(seed=1):
    """Variants of one text that are linked through others, so no hub reaches all of them."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    rows = []
    for k in range(40):
        words = base[:]
        for j in range(k % 9):
            words[(k * 13 + j * 21) % 200] = f"v{k}x{j}"
        rows.append((1000 - k, " ".join(words), "en", "s", 0))
    return rows


@pytest.mark.parametrize("how", [neardup.TRIPLES, neardup.Similarity(block=8)], ids=["triples", "fives"])
def test_against_brute_force(spark, how):
    rows = corpus.documents(5) + chained() + [(2000, "One  two", "x", "s", 0), (2001, "one\ttwo", "x", "s", 0)]
    table = spark.createDataFrame(rows, corpus.SCHEMA).repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in neardup.report(spark, table, how).collect()}
    assert got == brute(rows, how)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = "some words that are here twice or more"
    table = spark.createDataFrame([(None, text, 1), (3, text, 2), (3, text, 2), (7, text, 3)], "doc_id long, text string, key int")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.report(spark, table).collect())
    assert got == [(0, 0, True), (3, 3, True), (3, 3, True), (7, 3, False)]
    assert neardup.one_of_each(spark, table).columns == table.columns
    assert neardup.report(spark, table.limit(0)).collect() == []


def test_signatures_estimate_similarity_with_less_variance():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(80):
        u = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.unique(u[:200]), np.unique(np.concatenate([u[20:200], u[200:220]]))
        s = minhash.signatures([a, b], 128)
        off.append((s[0] == s[1]).mean() - 180 / 220)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.033


def test_rows_that_repeat_an_id_keep_their_own_links(spark):
    rng = random.Random(2)
    a, b = (" ".join(f"w{rng.randrange(10_000)}" for _ in range(120)) for _ in range(2))
    rows = [(1, a), (1, b), (5, a), (6, b), (7, a + " extra"), (8, b + " extra"), (3, b), (3, "a text of its own that nobody repeats at all")]
    schema = "doc_id long, text string"
    got = neardup.report(spark, spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (3, 1), (3, 3), (5, 1), (6, 1), (7, 1), (8, 1)]
    both = [(4, a), (2, a + " extra"), (4, b), (9, b + " extra"), (4, b)]
    got = neardup.report(spark, spark.createDataFrame(both, schema)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(2, 2), (4, 2), (4, 4), (4, 4), (9, 4)]
    kept = neardup.one_of_each(spark, spark.createDataFrame(both, schema)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(2, a + " extra"), (4, b), (4, b)]
    one = neardup.one_of_each(spark, spark.createDataFrame([(1, a), (1, a + " extra"), (2, a)], schema)).collect()
    assert len(one) == 1 and one[0]["doc_id"] == 1


def test_columns_of_any_name_are_kept(spark):
    text = "some words that are here twice or more"
    extra = ["_gone", "gone_id", "GONE_MARK", "mark", "node", "component_id", "n_shingles", "d1", "kept"]
    table = spark.createDataFrame([(3, text, *range(9)), (7, text, *range(9)), (8, None, *range(9))], ["doc_id", "text", *extra])
    got = neardup.one_of_each(spark, table)
    assert got.columns == table.columns and sorted(r["doc_id"] for r in got.collect()) == [3, 8]
