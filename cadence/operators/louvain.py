"""Connected components of an edge table, and Louvain communities within each.

The gain of a move needs only the weights around a node and the total weight of the whole graph, so
components are optimised apart from each other with that total.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.plans.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """account_id, component: the smallest id that an account's edges (src, dst) lead to.

    Labels spread to neighbours and then jump to their label's label, so paths halve each round.
    """
    links = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(links.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("component")).withColumnRenamed("src", "account_id"))
    while True:
        near = links.join(labels.withColumnRenamed("account_id", "dst"), "dst").groupBy(F.col("src").alias("account_id")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "account_id").select("account_id", "component", F.least("component", "near").alias("next"))
        up = labels.select(F.col("account_id").alias("next"), F.col("component").alias("above"))
        fresh = cut(spread.join(up, "next", "left").select("account_id", F.col("component").alias("was"), F.least("next", F.coalesce("above", "next")).alias("component")))
        moved = fresh.filter("was <> component").limit(1).count()
        labels = fresh.select("account_id", "component")
        if not moved:
            return labels


def louvain(edges: list[tuple[str, str, float]], total: float, resolution: float, seed: int) -> dict[str, int]:
    """The community of each node of a weighted graph; ``total`` is the weight of the whole graph."""
    weights: dict[str, dict[str, float]] = {}
    for a, b, w in edges:
        weights.setdefault(a, {})[b] = weights.setdefault(a, {}).get(b, 0.0) + w
        weights.setdefault(b, {})[a] = weights.setdefault(b, {}).get(a, 0.0) + w
    nodes = sorted(weights)
    place = {n: k for k, n in enumerate(nodes)}
    graph = [{place[b]: w for b, w in weights[n].items()} for n in nodes]
    loops = [0.0] * len(nodes)
    belongs = list(range(len(nodes)))
    rng = random.Random(seed)
    while True:
        home, improved = _moved(graph, loops, total, resolution, rng)
        names = {c: k for k, c in enumerate(dict.fromkeys(home))}
        belongs = [names[home[c]] for c in belongs]
        if not improved or len(names) == len(graph):
            return {n: belongs[k] for k, n in enumerate(nodes)}
        graph, loops = _folded(graph, loops, [names[c] for c in home], len(names))


def _moved(graph: list[dict[int, float]], loops: list[float], total: float, resolution: float, rng: random.Random) -> tuple[list[int], bool]:
    """Nodes move to the neighbouring community of largest gain until none gains."""
    degree = [sum(near.values()) + 2 * loop for near, loop in zip(graph, loops, strict=True)]
    home, inside = list(range(len(graph))), list(degree)
    improved, going = False, True
    order = list(range(len(graph)))
    rng.shuffle(order)
    while going:
        going = False
        for k in order:
            own = home[k]
            links: dict[int, float] = {}
            for other, w in graph[k].items():
                links[home[other]] = links.get(home[other], 0.0) + w
            inside[own] -= degree[k]
            cost = resolution * degree[k] / (2 * total)
            best, most = own, links.get(own, 0.0) - cost * inside[own]
            for community in sorted(links):
                gain = links[community] - cost * inside[community]
                if gain > most + 1e-12:
                    best, most = community, gain
            inside[best] += degree[k]
            if best != own:
                home[k] = best
                improved = going = True
    return home, improved


def _folded(graph: list[dict[int, float]], loops: list[float], home: list[int], n: int) -> tuple[list[dict[int, float]], list[float]]:
    """The graph whose nodes are the communities."""
    folded: list[dict[int, float]] = [{} for _ in range(n)]
    own = [0.0] * n
    for k, near in enumerate(graph):
        own[home[k]] += loops[k]
        for other, w in near.items():
            a, b = home[k], home[other]
            if a == b:
                own[a] += w / 2
            else:
                folded[a][b] = folded[a].get(b, 0.0) + w
    return folded, own


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """account_id, community: the smallest member names a community.

    Accounts without an edge have none.  The total weight is one number on the driver; a component
    is optimised in one task, since moves depend on each other.
    """
    total = edges.agg(F.sum("weight")).first()[0]
    if not total:
        return edges.select(F.col("src").alias("account_id"), F.col("src").alias("community")).limit(0)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = louvain(list(zip(group["src"], group["dst"], group["weight"].astype(float), strict=True)), float(total), resolution, seed)
        names: dict[int, str] = {}
        for node, community in found.items():
            names[community] = min(names.get(community, node), node)
        return pd.DataFrame({"account_id": list(found), "community": [names[c] for c in found.values()]}, dtype=object)

    labels = components(edges).withColumnRenamed("account_id", "src")
    return edges.select("src", "dst", "weight").join(labels, "src").groupBy("component").applyInPandas(run, "account_id string, community string")
