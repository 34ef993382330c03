"""Pairs of near fingerprints against plain versions, in small, large and crowded buckets."""

from dataclasses import replace

import numpy as np
import pytest

from cadence.functions import meeting
from cadence.operators import coordination as co
from cadence.plans import graph_queries, registry

CONFIG = co.CoordinationConfig(window_seconds=10.0)
SCHEMA = "post_id string, account_id string, micros long, root string, fingerprint long"


def near_copies(rng, n, themes):
    base = rng.integers(0, 1 << 63, themes, np.uint64)
    return base[rng.integers(0, themes, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))


def planted(n, seconds, themes=9):
    rng = np.random.default_rng(n)
    fp = near_copies(rng, n, themes).view(np.int64).tolist()
    micros = (rng.integers(0, seconds * 4, n) * 250_000).tolist()
    roots = [None if k % 3 else f"t{k % 2}" for k in range(n)]
    return [(str(k), None if k == 5 else f"a{k % 7}", micros[k], roots[k], None if k == 6 else fp[k]) for k in range(n)]


def plain(rows, max_hamming=6):
    rows = sorted((r for r in rows if r[1] is not None and r[4] is not None), key=lambda r: (r[2], r[0]))
    out = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if b[2] - a[2] <= 10_000_000 and a[1] != b[1] and (a[3] is None or a[3] != b[3]) and ((a[4] ^ b[4]) & (1 << 64) - 1).bit_count() <= max_hamming:
                out.add((a[0], b[0]))
    return out


@pytest.mark.parametrize("max_hamming", [6, 7])
@pytest.mark.parametrize("crowd", [3, 10**6])
@pytest.mark.parametrize("small", [2, 10**6])
def test_pairs_in_every_kind_of_bucket(spark, monkeypatch, max_hamming, crowd, small):
    monkeypatch.setattr(meeting, "SMALL", small)
    rows = planted(300, 40)
    config = replace(CONFIG, max_hamming=max_hamming)
    got = [(r["post_id_a"], r["post_id_b"]) for r in co.pairs(spark.createDataFrame(rows, SCHEMA), config, crowd=crowd).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, max_hamming)


def test_close_and_agreeing_in_a_large_group():
    rng = np.random.default_rng(1)
    n = 3 * meeting.SMALL
    fp, late = near_copies(rng, n, 400), rng.random(n) < 0.6
    starts, sizes = np.array([0]), np.array([n])
    got = np.concatenate([np.stack([a, b]) for a, b, _ in meeting.close(fp, late, starts, sizes, np.array([-1]), 6)], axis=1)
    a, b = np.nonzero((np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 6) & late[None, :])
    assert got.shape[1] == len(a) and {*map(tuple, got.T.tolist())} == {*zip(a.tolist(), b.tolist(), strict=True)}
    for least in (1, 2):
        alike = np.zeros((n, n), np.uint8)
        for k in range(8):
            one = fp >> np.uint64(8 * k) & np.uint64(255)
            alike += one[:, None] == one[None, :]
        met = (alike >= least) & late[None, :] & (~late[:, None] | np.tri(n, n, -1, dtype=bool).T)
        assert meeting.agreeing(fp, late, starts, sizes, least) == int(met.sum())


def test_groups_stay_whole_over_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(meeting, "ROWS", 4)
    keys = [1, 1, 1, 2, 2, 3, 3, 3, 3, 3, 3, 4]
    batches = [pa.RecordBatch.from_pydict({"k": keys[a : a + 3]}) for a in range(0, 12, 3)]
    seen = [table.column("k").to_pylist()[s] for table, starts, sizes in meeting.grouped(iter(batches), ["k"]) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True) if keys.count(table.column("k").to_pylist()[s]) == n]
    assert seen == [1, 2, 3, 4]


def test_pairs_are_found_without_a_join_over_bands(spark):
    """The rows that move are the posts, twice; 28 keys a post met each other in a join before."""
    found = co.pairs(spark.createDataFrame(planted(50, 40), SCHEMA), CONFIG)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_registered_queries_have_no_budget(spark, tmp_path, monkeypatch):
    """Their SQL has none, so they give all rows however many comparisons these take."""
    monkeypatch.setattr(graph_queries, "CONFIG", replace(graph_queries.CONFIG, max_candidate_pairs=1))
    spark.range(60).selectExpr("id AS event_id", "timestamp_micros(1704067200000000 + id * 1000000) AS ts", "id % 5 AS user_id", "'view' AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    assert graph_queries.fingerprint_membership(spark, str(tmp_path)).count() == 5


def events(spark, tmp_path):
    spark.range(60).selectExpr("id AS event_id", "timestamp_micros(1704067200000000 + id * 1000000) AS ts", "id % 5 AS user_id", "'view' AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_edges_and_examples_come_without_a_join(spark, tmp_path):
    """Keys of bands that met in a join filled the driver when one side was broadcast."""
    at = events(spark, tmp_path)
    for query in (graph_queries.fingerprint_edges, graph_queries.fingerprint_examples):
        assert "Join" not in query(spark, at)._jdf.queryExecution().optimizedPlan().toString()


def test_the_null_summary_makes_no_communities(spark, tmp_path, monkeypatch):
    def none(*_):
        raise AssertionError("the summary has no communities")

    monkeypatch.setattr(co, "communities", none)
    (row,) = graph_queries.fingerprint_null_summary(spark, events(spark, tmp_path)).collect()
    assert row["permutations"] == graph_queries.PERMUTATIONS and row["observed_edges"] == 10


def test_the_window_sweep_makes_no_communities(spark, tmp_path, monkeypatch):
    def none(*_):
        raise AssertionError("the sweep has no communities")

    monkeypatch.setattr(co, "communities", none)
    got = graph_queries.fingerprint_windows(spark, events(spark, tmp_path)).collect()
    assert [tuple(r) for r in got] == [(w, 10) for w in graph_queries.SWEEP]


def test_edges_of_windows_equal_those_of_each_window(spark):
    records = spark.createDataFrame(planted(300, 40), SCHEMA)
    windows = [0.25, 10.0, 0.5, 3.0]
    want = [co.edges(co.pairs(records, replace(CONFIG, window_seconds=w)), CONFIG).count() for w in windows]
    assert co.window_edges(records, windows, CONFIG) == want and len(set(want)) > 1


def test_examples_are_gathered_from_few_rows(spark, monkeypatch):
    """All rows of two accounts were gathered for three of them."""
    monkeypatch.setattr(meeting, "PAIRS", 50)
    found = co.pairs(spark.createDataFrame(planted(300, 40), SCHEMA).coalesce(1), CONFIG).cache()
    want = {(r["src"], r["dst"]): r["examples"] for r in co.edges(found.drop("early"), CONFIG).collect()}
    got = {(r["src"], r["dst"]): r["examples"] for r in co.edges(found, CONFIG).collect()}
    assert got == want and any(len(x) == co.EXAMPLES for x in got.values())
    assert found.filter("early").count() < found.count()


def test_among_first_keeps_ties():
    group, order = np.array([2, 1, 2, 2, 1, 2, 2]), np.array([5, 9, 1, 5, 9, 7, 0])
    assert meeting.among_first(group, order, 3).tolist() == [True, True, True, True, True, False, True]
    assert meeting.among_first(group[:0], order[:0], 3).tolist() == []
    assert meeting.unordered(np.array([3, 1]), np.array([1, 3])).tolist() == [4294967299] * 2


def copies(spark, tmp_path):
    text = "three hundred families will lose the only bridge that they have to the market"
    spark.createDataFrame([(k, text, f"s{k % 4}") for k in range(12)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_coposting_edges_come_without_a_join(spark, tmp_path):
    found = registry.coposting_edges(spark, copies(spark, tmp_path))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 6


def test_coposting_features_broadcast_no_table(spark, tmp_path):
    """Spark judges edges and clusters by their compressed size; their rows would go through the driver."""
    found = registry.coposting_features(spark, copies(spark, tmp_path))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["coord_partner_count"] for r in found.collect()] == [3.0] * 4


@pytest.mark.parametrize("crowd", [3, 10**6])
@pytest.mark.parametrize("small", [2, 10**6])
def test_weights_equal_edges(spark, monkeypatch, crowd, small):
    monkeypatch.setattr(meeting, "SMALL", small)
    monkeypatch.setattr(meeting, "PAIRS", 50)
    records = spark.createDataFrame(planted(300, 40), SCHEMA).coalesce(1)
    want = co.edges(co.pairs(records, CONFIG), CONFIG).drop("examples").sort("src", "dst").collect()
    got = co.weights(records, CONFIG, crowd).sort("src", "dst").collect()
    assert got == want and len(got) > 5


def test_equal_evidence_leaves_a_task_as_one_row(spark, tmp_path):
    """Copies of the same posts met each other in as many rows as there are pairs, each with its posts."""
    rows = [(str(k), f"a{k % 2}", k % 2 * 1_000_000, None, 7) for k in range(200)]
    found = co.weights(spark.createDataFrame(rows, SCHEMA), CONFIG)
    (row,) = found.collect()
    assert (row["weight"], row["mean_similarity"], row["median_lag_seconds"]) == (10_000, 1.0, 1.0)
    plan = graph_queries.fingerprint_edges(spark, events(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    (made,) = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert "n#" in made and "post_id_a" not in made


def test_counted_and_gathered(monkeypatch):
    first, n = meeting.counted(np.array([1, 2, 1, 1]), np.array([5, 5, 5, 6]))
    assert {(int(k), int(c)) for k, c in zip(first, n, strict=True)} == {(0, 2), (1, 1), (3, 1)}
    assert [len(x) for x in meeting.counted(np.zeros(0, np.int64))] == [0, 0]
    monkeypatch.setattr(meeting, "PAIRS", 3)
    s, t = object(), object()
    found = [(x, None, np.arange(k)) for x, k in ((s, 2), (s, 2), (s, 1), (t, 1))]
    assert [(x is s, len(a)) for x, _, a in meeting.gathered(iter(found))] == [(True, 4), (True, 1), (False, 1)]
