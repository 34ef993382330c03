"""Coordination on planted corpora."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cadence.corpus import ACCOUNTS, build_corpus
from cadence.functions.simhash import simhash64
from cadence.operators import coordination as co
from cadence.operators.louvain import louvain

EPOCH = datetime(2024, 3, 1, 12, tzinfo=UTC)
TEMPLATES = [
    "the council has decided behind closed doors to close the old harbour road for good, and nobody has asked the people who live and work along it every single day",
    "three hundred families will lose the only bridge that they have to the market, while the money goes to a stadium that stands empty for most of the year",
    "ask your representative tonight why the report about the water was kept back until the vote was over, and share the answer with everybody you know here",
]


def posts(spark, rows):
    table = spark.createDataFrame([(p, a, "generic", at, t, k, r) for p, a, at, t, k, r in rows], "post_id string, account_id string, platform string, created_at timestamp, text string, kind string, root_post_id string")
    return build_corpus(spark.createDataFrame([], ACCOUNTS), table)


def coordinated():
    rows = []
    for wave, template in enumerate(TEMPLATES):
        for k in range(4):
            at = EPOCH + timedelta(minutes=240 * wave, seconds=40 * k)
            rows.append((f"w{wave}a{k}", f"acct{k}", at, f"{template} {'!' * k}", "original", None))
    for k in range(5):
        rows.append((f"o{k}", f"organic{k}", EPOCH + timedelta(minutes=97 * k), f"what I saw on my walk number {k} " + "leaf moss stone "[k:] * (k + 2), "original", None))
    return rows


def test_planted_cluster(spark):
    result = co.detect(posts(spark, coordinated()), permutations=5)
    edges = result.edges.collect()
    assert len(edges) == 6 and {e["weight"] for e in edges} == {3}
    lags = {(e["src"], e["dst"]): e["median_lag_seconds"] for e in edges}
    assert lags["acct0", "acct1"] == 40.0
    (cluster,) = result.clusters.collect()
    assert (cluster["cluster_id"], cluster["size"], cluster["density"]) == ("c000", 4, 1.0)
    row = {r["account_id"]: r for r in co.features(result).collect()}
    assert row["acct0"]["coord_partner_count"] == 3 and row["acct0"]["coord_cluster_size"] == 4
    assert row["organic0"]["coord_partner_count"] == 0 and row["organic0"]["coord_median_lag_seconds"] is None
    null = co.null_summary(result.null_model, 6)
    assert null["permutations"] == 5 and null["p_value"] == pytest.approx(1 / 6)


def test_guards(spark):
    text = TEMPLATES[0]
    thread = [(f"{k}{t}", f"a{k}", EPOCH + timedelta(seconds=k + 60 * t), text, "original", "root") for k in range(3) for t in range(2)]
    assert co.detect(posts(spark, thread)).edges.count() == 0
    assert co.detect(posts(spark, thread), co.CoordinationConfig(exclude_same_thread=False)).edges.count() == 3
    reposts = [(f"{k}{t}", f"a{k}", EPOCH + timedelta(seconds=k, hours=t), TEMPLATES[t], "repost", None) for k in range(3) for t in range(3)]
    assert co.detect(posts(spark, reposts)).edges.count() == 0
    assert co.detect(posts(spark, reposts), co.CoordinationConfig(include_reposts=True)).edges.count() == 3
    assert co.eligible(posts(spark, [("1", "a", EPOCH, "far too short a text", "original", None)]).posts, co.CoordinationConfig()).count() == 0


def test_budget_and_config(spark):
    with pytest.raises(co.CandidateBudgetError):
        co.detect(posts(spark, coordinated()), co.CoordinationConfig(max_candidate_pairs=3))
    for bad in ({"window_seconds": 0}, {"max_hamming": 8}, {"shingle_size": 0}):
        with pytest.raises(ValueError):
            co.CoordinationConfig(**bad)


def test_pairs_equal_brute_force(spark):
    corpus = posts(spark, coordinated())
    config = co.CoordinationConfig()
    got = {(r["post_id_a"], r["post_id_b"]) for r in co.pairs(co.eligible(corpus.posts, config), config).collect()}
    rows = sorted((r["created_at"], r["post_id"], r["account_id"], simhash64(r["text"])) for r in corpus.posts.collect())
    want = {(a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[2] != b[2] and (b[0] - a[0]).total_seconds() <= 900 and (a[3] ^ b[3]).bit_count() <= 6}
    assert got == want


def test_fingerprints_are_stable():
    assert simhash64("hola que tal") == 312879931155061397
    assert simhash64("") == 0


def test_louvain_splits_two_cliques():
    clique = [(a, b, 1.0) for a in "abcd" for b in "abcd" if a < b] + [(a, b, 1.0) for a in "wxyz" for b in "wxyz" if a < b] + [("d", "w", 1.0)]
    found = louvain(clique, 13.0, 1.0, 1)
    assert len({found[x] for x in "abcd"}) == 1 and found["a"] != found["z"]


def test_sensitivity_and_shuffle(spark):
    corpus = posts(spark, coordinated())
    table = co.window_sensitivity(corpus, [60.0, 900.0])
    assert list(table["edges"]) == [3, 6]
    records = co.eligible(corpus.posts, co.CoordinationConfig())
    moved = co.shuffled(records, 2, 1)
    assert moved.groupBy("perm").agg(F.sum("micros")).select("sum(micros)").distinct().count() == 1


def test_registered_null_model_has_the_permutations_of_the_operator(spark, tmp_path):
    from cadence.plans import registry

    spark.createDataFrame([(1, "some text of a post", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.coposting_null_model(spark, str(tmp_path)).count() == 100
