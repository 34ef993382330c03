"""Sums, numbers and percentiles over an order, and fingerprints, against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from cadence.corpus import ACCOUNTS, build_corpus
from cadence.functions import simhash
from cadence.functions.scalar import character_entropy
from cadence.plans.order import numbered, percentiles, running


def test_running_sums_and_numbers_cross_ranges(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 9), rng.random()) for k in range(500)]
    table = spark.createDataFrame(rows, "id int, n int, at double")
    want, total = {}, 0
    for nth, (k, n, _) in enumerate(sorted(rows, key=lambda r: r[2])):
        total += n
        want[k] = (total, nth)
    sums = {r["id"]: r["so_far"] for r in running(table, [F.col("at")], {"so_far": F.col("n")}).collect()}
    nths = {r["id"]: r["nth"] for r in numbered(table, [F.col("at")], "nth").collect()}
    assert {k: (sums[k], nths[k]) for k in sums} == want


def test_percentiles_equal_numpy(spark):
    rng = random.Random(4)
    rows = [(key, float(rng.randint(0, 12)) if rng.random() < 0.8 else None) for key in "abc" for _ in range(rng.randint(1, 90))] + [("d", None)]
    got = {r["key"]: r["q"] for r in percentiles(spark.createDataFrame(rows, "key string, v double"), ["key"], "v", (0.1, 0.5, 0.9)).collect()}
    assert set(got) == {"a", "b", "c"}
    for key, q in got.items():
        assert np.allclose(q, np.quantile([v for k, v in rows if k == key and v is not None], (0.1, 0.5, 0.9)))


def test_fingerprints_equal_votes_one_by_one(monkeypatch):
    from hashlib import blake2b

    def plain(text, size=5):
        votes = [0] * 64
        for i in range(max(1, len(text) - size + 1)):
            digest = int.from_bytes(blake2b(text[i : i + size].encode(), digest_size=8).digest(), "big")
            for b in range(64):
                votes[b] += 1 if digest >> b & 1 else -1
        return sum(1 << b for b in range(64) if votes[b] > 0) if text else 0

    rng = random.Random(5)
    texts = ["".join(rng.choices("ab cé漢😀", k=rng.randint(0, 40))) for _ in range(60)] + ["".join(map(chr, rng.sample(range(0x4E00, 0x9000), 9000)))]
    want = [plain(x) for x in texts]
    for block in (40, simhash.BLOCK):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert simhash.simhashes(texts).tolist() == want
    assert simhash.simhash64("La reforma que aprobaron de madrugada no arregla nada") == 1222999411927696821
    assert simhash.normalise_text("  See HTTPS://x.y/z  @Some.One ＡＢ\tc ") == "see ab c"


def test_character_entropy(spark):
    rows = spark.createDataFrame([("aabb",), ("aaaa",), ("",), (None,), ("abcd",)], "t string")
    assert [r["e"] for r in rows.select(character_entropy(F.col("t")).alias("e")).collect()] == [1.0, 0.0, 0.0, None, 1.0]


def test_orphans_and_last_accounts(spark):
    posts = spark.createDataFrame([("1", "a", "generic"), ("2", "z", "generic")], "post_id string, account_id string, platform string")
    accounts = spark.createDataFrame([("a", "generic", "old"), ("a", "generic", "new"), ("b", "generic", "b")], "account_id string, platform string, handle string").coalesce(1)
    corpus = build_corpus(accounts.select(*accounts.columns), posts.select("*"))
    assert [r["post_id"] for r in corpus.orphan_posts().collect()] == ["2"]
    assert {r["account_id"]: r["handle"] for r in corpus.accounts_by_id().collect()} == {"a": "new", "b": "b"}
    assert len(ACCOUNTS) and corpus.silent_accounts().collect()[0]["account_id"] == "b"
